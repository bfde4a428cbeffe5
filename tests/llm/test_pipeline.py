"""The pipeline's kept documents and digests against plain Python, stage by stage, with planted cases."""

import hashlib
import re
from collections import Counter

from test_llm import _spans
from tokenizers import Tokenizer

import corpus_pipeline
from sextant.llm import quality_rules
from sextant.llm.queries import _vocabulary


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def like(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def one_of_each(docs):
    """Least id of each class of texts whose shingles are alike, directly or over others."""
    sets = {k: shingles(t) for k, t in docs.items()}
    root = {k: k for k in docs}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and (docs[a] == docs[b] or like(sets[a], sets[b]) >= 0.8):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: docs[k] for k in docs if top(k) == k}


def redacted(text):
    spans = [tuple(map(int, s.split(":")[1:])) for s in _spans(text)[-1].split(",") if s]
    out, at, end = [], 0, -1
    for s, e in sorted(spans):
        if s > end:
            out.append(text[at:s] + "[REDACTED]")
        at = end = max(end, e)
    return "".join([*out, text[at:]])


def test_pipeline_equals_plain_python(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = [r for r in quality_rules.keep_good(docs).collect() if len(words(r.text)) > 120][:3]
    first = good[0].asDict()
    planted = [
        {**first, "doc_id": 10_001},
        {**first, "doc_id": 10_002, "text": good[0].text + " one more word"},
        {**good[1].asDict(), "doc_id": 10_003, "text": good[1].text.replace(" ", f" {items[0]} ", 1)},
        {**good[2].asDict(), "doc_id": 10_004, "text": " ".join(reversed(good[2].text.split())) + " password=hunter2hunter2 <|ENDOFTEXT|>"},
    ]
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    stored = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {r.doc_id: r.text for r in quality_rules.keep_good(stored).collect()}
    assert {10_001, 10_002, 10_003} <= set(left)
    left = one_of_each(left)
    held = [f" {' '.join(words(i))} " for i in items]
    left = {k: t for k, t in left.items() if not any(h in f" {' '.join(words(t))} " for h in held)}
    assert set(found) == set(left) and not {10_001, 10_002, 10_003} & set(found)
    library = Tokenizer.from_file(_vocabulary("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    for k, t in left.items():
        ids = library.encode(redacted(t), add_special_tokens=False).ids
        assert found[k].n_tokens == len(ids)
        assert found[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
