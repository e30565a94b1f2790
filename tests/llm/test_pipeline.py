from __future__ import annotations

import hashlib
import re

import corpus_pipeline
from shoebox.llm import queries
from shoebox.llm.session import table

from .data import TEXTS, edges, empty
from .test_decontaminate import brute
from .test_dedup import brute_groups, first_of_similar


def test_stages_against_brute_force(spark, small, tmp_path):
    docs = table(spark, small, "documents")
    net = queries.quality_network(spark, docs, small)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [x for x in rows if net.score((x[1] or "").encode()) >= 0.3]
    keep = {i for i, _ in brute_groups(rows).values()}
    rows = [x for x in rows if x[0] in keep]
    keep = set(first_of_similar(rows))
    rows = [x for x in rows if str(x[0]) in keep]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    grams = {g for _, t in items for g in re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())}
    suspects = [x for x in rows if grams & set(x[1].lower().split())]  # the others share no word
    bad = {i for i, *_, c in brute(suspects, items) if c}
    rows = [x for x in rows if str(x[0]) not in bad]
    out = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, small).collect()}
    assert out == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}


def test_stages_bear_odd_rows(spark, tiny):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "decontamination", "bpe"]
    for make in (edges, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, make(spark), tiny)
            n = out.count()
            assert n <= len(TEXTS) and (make is edges or n == 0)
            if k < 4:
                assert out.columns == make(spark).columns
