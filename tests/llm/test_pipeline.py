"""The pipeline against a brute-force version in plain Python."""

import os
import zlib

import numpy as np

import corpus_pipeline
from sparkmail.llm.pieces import tokenizer_path
from sparkmail.session import stage_table
from test_decontaminate import brute as contaminated
from test_near_dup import brute as near_dup
from test_near_dup import template_group
from test_secret_scan import brute as secrets
from tests_support import SF

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def masked(text):
    out, at = [], 0
    for start, _, _, end in secrets(text):
        if start >= at or not out:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_run_against_brute_force(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    one = near_dup(docs, 5, 80)
    docs = [(i, t) for i, t in docs if one[i][2]]
    bad = {r[0] for r in contaminated(docs, items) if r[5]}
    docs = [(i, masked(t)) for i, t in docs if i not in bad]
    want = set()
    for i, t in docs:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want |= {(i, a, len(ids[a:a + 1024]), zlib.crc32(ids[a:a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert bad and len(got) == len(want)
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "12 34", "en", None, 5), (3, "some words here", "en", "s", 15),
            (3, "some words here", "en", "s", 15), (None, "password=abcdefgh é", None, "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, stage_table(stage(spark, docs, SF), "test-stage")
        assert docs.columns == before, name
    left = sorted([tuple(r) for r in docs.collect()], key=repr)
    assert left == sorted([(3, "some words here", "en", "s", 15)] * 2 + [(None, "[SECRET] é", None, "s", 10)], key=repr)
    assert stage_table(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "test-stage").count() == 3
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_duplicates_of_a_large_template_group(spark):
    """2,000 documents of one template in pairs: 0.810 within a pair, 0.763 between pairs; 30 of them also against brute force."""
    rows = template_group(2000, 36, 10)
    small = near_dup(rows[:30], 5, 80)
    assert all(small[i][2] == (i % 2 == 0) for i, _ in rows[:30])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == list(range(0, 2000, 2))
