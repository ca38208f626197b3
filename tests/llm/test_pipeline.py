"""The pipeline and the registered queries."""

from collections import Counter

import corpus_pipeline
from tests.llm import test_near
from tests.llm.test_quality import plain as measures
from wavespark.llm import mixing, packing, quality, queries, storage


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, given = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "mix_sources", "best_fit"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.table(stage(spark, docs, data), name)
        out[name] = docs.collect()
        if name != "best_fit":
            assert docs.columns == columns
            assert all(r == given[r["doc_id"]] for r in out[name])

    votes = quality.measures(spark.read.parquet(f"{data}/documents.parquet")).collect()
    post = quality.estimate(Counter(r["votes"] for r in votes)).posterior
    good = {r["doc_id"] for r in votes if post[r["votes"]] >= 0.5 and (m := measures(given[r["doc_id"]]["text"]))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    assert {r["doc_id"] for r in out["quality_rules"]} == good

    classes = test_near.plain([(d, given[d]["text"]) for d in good])
    assert sorted(r["doc_id"] for r in out["jaccard_join"]) == sorted({c for _, c, _ in classes})

    kept = [r["doc_id"] for r in out["jaccard_join"]]
    mixed = Counter(r["doc_id"] for r in out["mix_sources"])
    sizes, goal = Counter(), mixing.targets
    for d in kept:
        sizes[given[d]["source"]] += measures(given[d]["text"])[0]
    goal = mixing.targets(dict(sizes), mixing.cyclic_weights(list(sizes)))
    for s in sizes:
        words = sum(n * measures(given[d]["text"])[0] for d, n in mixed.items() if given[d]["source"] == s)
        longest = max(measures(given[d]["text"])[0] for d in kept if given[d]["source"] == s)
        assert goal[s] - 1 <= words <= goal[s] + longest
    assert max(mixed.values()) <= 3

    packed = Counter()
    for r in out["best_fit"]:
        packed[r["doc_id"]] += r["n_words"]
    assert packed == Counter({d: n * measures(given[d]["text"])[0] for d, n in mixed.items()})
    assert all(r["seq_len"] in packing.LENGTHS for r in out["best_fit"])


def test_run(spark, data):
    assert sorted(map(repr, corpus_pipeline.run(spark, data).collect())) == sorted(map(repr, corpus_pipeline.run(spark, data).collect()))


def test_queries_run_and_agree_with_sql(spark, data, duck):
    names = queries.queries()
    assert sorted({int(k[2:].split("_")[0]) for k in names}) == list(range(1, 11))
    for name, sql in queries.oracle_sql().items():
        df = names[name](spark, data)
        want = duck.sql(sql)
        order = sorted(df.columns)
        assert order == sorted(want.columns)
        a = sorted(repr([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in order]) for r in df.collect())
        b = sorted(repr([round(x, 6) if isinstance(x, float) else x for x in (dict(zip(want.columns, r, strict=True))[c] for c in order)]) for r in want.fetchall())
        assert a == b, name


def test_every_row_has_a_result(spark, data):
    """Queries that give a row for each row do, with the contract's columns."""
    n = {t: spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("documents", "pages")}
    contract = {
        "op1": ("documents", "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature"), "op2": ("documents", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
        "op3": ("documents", "doc_id held_out n_tokens n_known train_tokens base_score score"), "op4": ("pages", "page_id payload_bytes payload_digest record_type refers_to"), "op5": ("documents", "doc_id class_id n_links"),
        "op6": ("documents", "doc_id size source_size target taken"), "op9": ("pages", "page_id url text n_chars"), "op10": ("documents", "doc_id start n_tokens ids_crc32"),
    }
    for name, f in queries.queries().items():
        if (op := name.split("_")[0]) in contract:
            table, columns = contract[op]
            df = f(spark, data)
            assert set(columns.split()) <= set(df.columns) and df.count() == n[table], name
