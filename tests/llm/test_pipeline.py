"""The pipeline's stages against plain versions of what they must do, each on its own input."""

import corpus_pipeline
from sievework.llm.queries import vocabulary

from .test_op9_jaccard_join import brute
from .test_operators import plain_rules


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        seen.append(([tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()], out.columns))
        docs = spark.createDataFrame(seen[-1][1], out.schema)
    (raw, ruled, a), (_, graded, b), (_, single, c), (_, pieces, _) = seen
    assert a == b == c == columns
    at = {n: i for i, n in enumerate(columns)}
    # rules: nothing that fails the base rules stays; lines are only taken away
    text = {r[at["doc_id"]]: r[at["text"]] for r in raw}
    assert ruled and all(not plain_rules(text[r[at["doc_id"]]])[5] for r in ruled)
    assert all(set(r[at["text"]].split("\n")) <= set(text[r[at["doc_id"]]].split("\n")) and r[at["n_chars"]] == len(r[at["text"]]) for r in ruled)
    # classifier: rows pass unchanged; toxic ones go, good ones stay
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(graded) <= set(ruled)
    kept = {r[at["doc_id"]] for r in graded}
    bad = [i for i in labels if labels[i][1] == 1 and i in {r[at["doc_id"]] for r in ruled}]
    good = [i for i in labels if labels[i] == (1, 0) and i in {r[at["doc_id"]] for r in ruled}]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad)
    # near duplicates: the lowest id of each component
    ordered = sorted(graded, key=lambda r: r[at["doc_id"]])
    parts = brute([r[at["text"]] for r in ordered])[1]
    assert sorted(single) == sorted(ordered[i] for i in set(parts))
    # packing: every token once
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r[at["text"]], add_special_tokens=False).ids) + 1 for r in single)
    assert sum(p[2] for p in pieces) == want and {p[0] for p in pieces} == {r[at["doc_id"]] for r in single}


def test_empty_tables(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with names used inside."""
    good = "The committee met on Monday, and its members spoke about the plan for the new bridge.\nThey agreed that work should begin in spring, once the river is low.\n"
    long = " ".join(f"word{i}, and" for i in range(30_000))
    texts = [None, "", " \n", good, good, good, good + "One more sentence ends it.", long, "x"]
    rows = [(None if i % 4 == 1 else i, x, None if i % 3 else "en", None, None if i == 4 else 7, i, "m", None) for i, x in enumerate(texts)]
    rows += [rows[3]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, mark string, whole string").repartition(3)
    rules, classifier, near, packing = (f for _, f in corpus_pipeline.STAGES)
    ruled = rules(spark, docs, sf)
    assert ruled.columns == docs.columns and sorted(len(r.text) for r in ruled.collect()) == sorted([len(good)] * 6 + [len(texts[6]), len(long)])
    graded = classifier(spark, docs, sf)
    assert graded.columns == docs.columns and graded.where("text is null").count() == 0
    left = near(spark, docs, sf).collect()
    assert len(left) == 6 and sorted(len(r.text or "") for r in left) == [0, 0, 1, 2, len(good), len(long)]
    assert [r.doc_id for r in left if r.text == good] == [3]
    pieces = packing(spark, docs, sf).collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces) and sum(p.start == 0 for p in pieces) == len(rows)
    assert all(f(spark, docs.limit(0), sf).count() == 0 for _, f in corpus_pipeline.STAGES)
