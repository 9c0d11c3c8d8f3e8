"""The pipeline and the registered queries on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from loomline.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes, kept = docs.columns, [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.save(stage(spark, kept, SF), name.replace(" ", "-"))
        assert kept.columns == columns
        sizes.append(kept.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2] and sizes[4] == sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == sizes[4]
    rows = lambda d: sorted(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in d.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(packed)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "embeddings", "documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
    as_rows = lambda f: sorted(map(tuple, f.astype(object).where(f.notna(), None).values.tolist()), key=str)
    assert as_rows(got) == as_rows(want)


def test_near_copies_by_five_word_shingles(spark):
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(30):
        base = r.choices(words, k=r.randint(30, 200))
        texts.append(base)
        for edits in (1, 2, 3, 6):
            copy = list(base)
            for at in r.sample(range(len(copy)), edits):
                copy[at] = r.choice(words)
            texts.append(copy)
    big = r.choices(words, k=150)
    texts += [[*big[:at], "x", *big[at:]] for at in range(0, 150, 4)] + [["short", "one"], ["short", "one"], [], []]
    r.shuffle(texts)
    docs = [(i * 7 % 1009, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in docs)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i in sets if find(i) == i)


def test_repeated_ids_lose_no_group(spark):
    rows = [(3, "one two three", 1), (5, "one two three", 2), (5, "four five six", 3), (None, "one two three", 4), (7, None, 5), (8, "", 6), (9, "four five six", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect() if r.doc_id) == [(3, "one two three", 1), (5, "four five six", 3), (7, None, 5)]
    assert [r.node for r in kept.collect() if not r.doc_id] == [4] and corpus_pipeline.keep_one_of_near_copies(spark, docs.limit(0), SF).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Every name that the stages use for a column of their own, with its values kept."""
    names = "gone gone_id gone_ta gone_tb _gone _gone_id _gone_ta _gone_tb ha hb n line key a b own root node id ta tb da db fp keys keeper first copies exact base all n_email _good _proposed _email component_id t start end".split()
    prose = "The committee read the report with care, and its members agreed that the harbour needs a wider entrance by spring. "
    texts = [prose + "Mail a@b.org.", prose + "Mail a@b.org.\nmore of it", prose * 2, None]
    rows = [(i, t, "en", "s", 5, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert {tuple(r)[5:] for r in kept.collect()} <= {r[5:] for r in rows}
    assert {r.doc_id: r.gone for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()} == {i: f"gone{i}" for i in range(4)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("doc_id is null").count() == 0


def test_stages_of_odd_rows(spark):
    """Nulls in every column, empty and repeated texts, repeated ids and extra columns whose names the operators use."""
    prose = "The committee read the report with care, and its members agreed that the harbour needs a wider entrance. "
    texts = [None, "", " \n\t", prose * 3, prose * 3, "Write to jo@example.org today. " + prose, "word " * 30_000, "é" * 50_000]
    rows = [(i, t, None, None, None, "x", 1) for i, t in enumerate(texts)] + [(3, prose, "en", "s", 1, None, None), (None, prose, "en", "s", 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, ha int")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        kept = corpus_pipeline.save(stage(spark, docs, SF), name.replace(" ", "-"))
        assert kept.columns == docs.columns
        got = {(r.doc_id, r.fp): r for r in kept.collect()}
        if name == "line dedup":
            assert len(got) == len(rows) and got[0, "x"].text is None and got[4, "x"].text == "" and got[None, "x"].text == prose
        elif name == "PII":
            assert len(got) == len(rows) and got[5, "x"].text.startswith("Write to [EMAIL] today.") and got[7, "x"].text == texts[7]
        else:
            assert (0, "x") in got and (3, "x") in got and (None, "x") in got and not {(1, "x"), (2, "x"), (4, "x")} & set(got)
        assert corpus_pipeline.save(stage(spark, docs.limit(0), SF), "none").count() == 0
    accepted = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert accepted.columns == docs.columns and corpus_pipeline.STAGES[0][1](spark, docs.limit(0), SF).count() == 0
    assert {r.doc_id for r in accepted.collect()} <= {r[0] for r in rows}
    pack = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in pack(spark, docs, SF).collect()} == {r[0] for r in rows} and pack(spark, docs.limit(0), SF).count() == 0
