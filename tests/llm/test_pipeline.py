"""Every stage of the pipeline against plain Python, on what the stage before kept."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from murmuration.llm import scratch

from .test_mixing import _targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(words, k=rng.randint(20, 90))
        if i % 5 == 0:
            w[5:8] = rng.sample(["idiot", "stupid", "worthless"], 3)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    base = rng.choices(words, k=200)
    for i in range(30):  # near copies of one text, and exact ones of others
        w = list(base)
        w[rng.randrange(200)] = "changed%d" % i
        rows += [(1000 + i, " ".join(w)), (2000 + i, rows[i % 7 + 1][1])]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, " ".join(rng.choices(words, k=60_000))), (3004, "an 1d10t " + rows[3][1]), rows[9], (None, "a row without an id " + rows[11][1])]
    sources = ["b", "a", None, "é"]
    rows = [(i, t, "en", sources[n % 4], len(t or "")) for n, (i, t) in enumerate(rows)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows, {r[0] for r in rows if r[1] and {"idiot", "1d10t", "stupid", "worthless"} & set(r[1].split())}


def _shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tables, tmp_path):
    from murmuration.llm import packing
    from tokenizers import Tokenizer

    at, rows, toxic = tables
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, docs, at)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [tuple(r) for r in docs.collect()]

    assert Counter(kept["toxicity"]) == Counter(r for r in rows if r[0] not in toxic)

    best = {}
    for r in kept["toxicity"]:
        best[r[1] or ""] = max(best.get(r[1] or "", -1), -1 if r[0] is None else r[0])
    assert sorted((r[1] or "", -1 if r[0] is None else r[0]) for r in kept["exact_dedup"]) == sorted(best.items())

    sets = {r[0]: _shingles(r[1]) for r in kept["exact_dedup"] if r[0] is not None}
    comp = {i: i for i in sets}
    for _ in range(3):
        for i in sets:
            for j in sets:
                if sets[i] and comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert Counter(kept["ngram_jaccard"]) == Counter(r for r in kept["exact_dedup"] if r[0] is None or comp[r[0]] == r[0])
    assert len(kept["ngram_jaccard"]) < len(kept["exact_dedup"]) - 20

    sizes, of = Counter(), {}
    for r in kept["ngram_jaccard"]:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
        of[r[0]] = (WORD.findall(r[1] or ""), r[1], r[2:])
    want, taken, per = _targets(dict(sizes)), Counter(), Counter()
    for r in kept["mixing"]:
        w, whole = of[r[0]][0], of[r[0]][1]
        mine = WORD.findall(r[1])
        assert r[1] == whole or f" {r[1]} " in f" {' '.join(w)} "  # whole, or a slice of its words
        assert r[2:] == of[r[0]][2]
        taken[r[3]] += len(mine)
        per[r[0]] += len(mine)
    assert all(abs(taken[s] - float(want[s])) <= 1 for s in sizes) and all(n <= 3 * len(of[i][0]) for i, n in per.items())

    tokenizer, pieces = Tokenizer.from_file(packing.default_vocabulary()), Counter()
    for r in kept["mixing"]:
        ids = tokenizer.encode(r[1], add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 1024):
            part = ids[k : k + 1024]
            pieces[r[0], k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    names = docs.columns
    got = [dict(zip(names, r, strict=True)) for r in kept["packing"]]
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == pieces
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024


def test_run(spark, tables, tmp_path):
    at, rows, _ = tables
    before = scratch.mark()
    got = corpus_pipeline.run(spark, at)
    assert got.count() > 0 and got.where("doc_id = 3003").count() > 1
    assert scratch.mark() - before <= 12  # the stages' own tables are gone
    for t, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
