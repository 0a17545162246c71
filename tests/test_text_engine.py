"""The text engine on small corpora with known values, and its queries against their SQL."""

import math
import random
import sqlite3
from collections import Counter
from itertools import combinations

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom import queries
from wordloom.functions import normalize
from wordloom.functions.pos import useful_words
from wordloom.operators import association as A
from wordloom.operators import corpus as C
from wordloom.operators import exclusive as X
from wordloom.operators import pairs
from wordloom.operators import search as S
from wordloom.operators import views as V
from wordloom.operators.prepared import prepare
from wordloom.plans import oracle
from wordloom.plans.engine import TextEngine
from wordloom.sources import datasets
from wordloom.sources.store import SentenceStore, export_scores
from wordloom.streaming import sentence_stream

DIR = "/root/testdata/sf0.001"
ROWS = ["machine learning algorithm", "machine learning model", "deep learning neural", "learning teacher school", "brain neural science"]


@pytest.fixture(scope="module")
def found(spark):
    return C.from_processed(spark.createDataFrame(list(enumerate(ROWS)), "sentence_index long, processed_text string")).persist()


def test_counts_and_scores(found):
    count = lambda a, b: A.pair_count(found, a, b).first()["cooc"]
    assert (count("machine", "learning"), count("Neural", "learning"), count("brain", "teacher"), count("machine", "machine")) == (2, 1, 0, 0)
    rows = {r["word"]: r["score"] for r in A.cluster(found, "machine", A.Options(filter_pos=False, use_freq_weighting=False)).collect()}
    assert rows["learning"] == pytest.approx(math.log(1.25), abs=1e-8)
    assert "neural" not in {r["word"] for r in A.cluster(found, "learning", A.Options(filter_pos=False)).collect()}
    assert A.cluster(found, "unknown").count() == 0
    assert A.cluster(found, "machine", A.Options(min_freq=100)).count() == 0
    stats = A.statistics(A.cluster(found, "unknown")).first()
    assert (stats["n_words"], stats["max_score"]) == (0, 0.0)


def test_search_and_frequencies(found):
    state = S.SearchState().narrowed("learning").narrowed("machine").narrowed("machine")
    assert state.words == ("learning", "machine")
    assert sorted(r["sid"] for r in S.matches(found, state).collect()) == [0, 1]
    assert S.matches(found, S.SearchState()).count() == 0 and S.containing(found, []).count() == 5
    assert [tuple(r) for r in C.most_frequent(C.vocab(found), 2).collect()] == [("learning", 4), ("machine", 2)]
    assert C.least_frequent(C.vocab(found), 0).count() == 0


def test_exclusive_clusters(found):
    rows = {r["sid"]: r["word"] for r in X.assigned(found).collect()}
    assert len(rows) == 5 and rows[4] == "neural"
    assert X.first_n(found, X.assigned(found), 99).count() == 5
    assert X.iterated(found, ["unknown"]).count() == 0


def test_highlights(spark):
    rows = spark.createDataFrame([(1, "Aaa banana")], "sid long, original_text string")
    assert V.highlights(rows, ["AA", "ana", "zz"]).first()["highlights"] == {"aa": [0, 1], "ana": [5, 7]}


def test_sources_and_store(spark, tmp_path):
    path = tmp_path / "twcs.csv"
    path.write_text('text,inbound\n"Buy, the car",True\nsecond,true\nout,False\n"  ",True\n')
    source = datasets.get_source("twitter_support")
    assert [r["text"] for r in datasets.read_csv(spark, str(path), source).orderBy("doc_index").collect()] == ["Buy, the car", "second"]
    assert datasets.read_csv(spark, str(path), source, 1).count() == 1
    with pytest.raises(ValueError, match="reddit, twitter_support"):
        datasets.get_source("x")
    store = SentenceStore(spark, str(tmp_path / "store"))
    made = C.dense_ids(C.sentences(datasets.read_csv(spark, str(path), source)))
    assert store.save("t", str(path), "1", made) == 2
    assert [r["processed_text"] for r in store.cached(str(path), "1").collect()] == ["buy car", "second"]
    assert store.cached(str(path), "2") is None and len(store.datasets()) == 1
    path.write_text("text,inbound\n")
    assert store.cached(str(path), "1") is None
    out = export_scores(spark.createDataFrame([("a", 0.5)], "word string, score double"), str(tmp_path / "scores"))
    assert spark.read.text(out).first()["value"] == "a: 0.500000"


@pytest.mark.parametrize(
    "name",
    ["csv_scan", "load_pipeline", "sentences_split", "sentences_without_text", "url_strip_literals", "posting_lists", "npmi_pairs", "assoc_pct30", "assoc_scoped",
     "assoc_with_stats", "pos_filter_batch", "tfidf_mean_all", "tfidf_export", "excl_legacy", "excl_drilled", "excl_sentences", "iter_excl_1seed", "path_sentences"],
)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({oracle.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(columns).collect()))) == sorted(map(str, expected))


def test_all_pairs_equal_brute_force(found):
    pairs = {}
    for row in ROWS:
        words = sorted(set(row.split()))
        for i, a in enumerate(words):
            for b in words[i + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    assert {(r["w1"], r["w2"]): r["cooc"] for r in A.pair_counts(found).collect()} == pairs


@pytest.mark.parametrize("name", ["npmi_pairs", "pmi_pairs", "pair_cooc"])
def test_pair_queries_shuffle_packed_blocks_only(spark, name):
    """No table is written for them, no row a pair or a word is shuffled, and a pair takes few bytes on the way."""
    queries.release(spark)
    rows = queries.QUERIES[name](spark, DIR)
    assert not queries._prepared
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and plan.count("RepartitionByExpression") == 1
    assert set(rows.columns) >= {"w1", "w2", "cooc"}
    ws = C.sentences(queries.documents(spark, DIR)).select(F.col("tokens").alias("ws"))
    sent = ws.mapInArrow(pairs._packed(2), pairs._PACKED).where("part >= 0").agg(F.sum(F.length("data"))).first()[0]
    assert sent < 4 * rows.count()


def _by_hand(sentences):
    count, df = Counter(), Counter()
    for row in sentences:
        words = sorted(set(row or ()))
        df.update(words)
        count.update(combinations(words, 2))
    return {(a, b, n, df[a], df[b], len(sentences)) for (a, b), n in count.items()}


def test_packed_pairs_equal_brute_force(monkeypatch):
    """Sources that are cut off early, counts too large for their room, null and empty rows, repeated words, letters of several bytes."""
    for name, value in (("RAW", 300), ("HELD", 900), ("ADDED", 500), ("_LOOKED_UP", 400), ("_ROWS", 70)):
        monkeypatch.setattr(pairs, name, value)
    rng = random.Random(5)
    words = [f"{c}{k}" for c in ("a", "é", "字", "🙂") for k in range(60)]
    rows = [[rng.choice(words[: rng.choice((3, 40, 240))]) for _ in range(rng.randrange(14))] for _ in range(900)] + [None, [], ["a0"], words[:50]] + [["a0", "a1", "a1"]] * 400
    for buckets in (1, 3, 64):
        sent = []
        for task in range(2):
            held, source = pairs._Source(buckets), 0
            for k in range(task, len(rows), 20):
                held.add(pa.array(rows[k : k + 20 : 2], pa.list_(pa.string())))
                if held.full():
                    sent, held, source = [*sent, held.blocks(task << 32 | source)], pairs._Source(buckets), source + 1
            sent.append(held.blocks(task << 32 | source))
        assert len(sent) > 4
        table = pa.Table.from_batches(sent).sort_by([(c, "ascending") for c in ("block", "part", "source")])
        columns = ("w1", "w2", "cooc", "df1", "df2", "n_sentences", "pmi", "npmi")
        found = [r for b in pairs._added(columns, 6)(iter(table.to_batches(max_chunksize=50))) for r in b.to_pylist()]
        expected = _by_hand(rows)
        assert len(found) == len(expected) and {tuple(r[c] for c in columns[:6]) for r in found} == expected
        for r in found:
            p = math.log(r["cooc"] * r["n_sentences"] / (r["df1"] * r["df2"]))
            assert r["pmi"] == pytest.approx(p, abs=1e-6) and r["npmi"] == pytest.approx(p / -math.log(r["cooc"] / r["n_sentences"]), abs=1e-6)


def test_pairs_of_frequent_words_and_scores(spark, found):
    rows = A.scored_pairs(found, min_df=2).collect()
    assert sorted((r["w1"], r["w2"], r["cooc"], r["df1"], r["df2"]) for r in rows) == [("learning", "machine", 2, 4, 2), ("learning", "neural", 1, 4, 2)]
    assert {r["w2"]: r["pmi"] for r in rows}["machine"] == pytest.approx(math.log(1.25))
    same = C.from_processed(spark.createDataFrame([(0, "a b"), (1, "B A")], "sentence_index long, processed_text string"))
    assert [tuple(r) for r in A.scored_pairs(same).collect()] == [("a", "b", 2, 2, 2, 0.0, 0.0)]
    assert A.pair_counts(same.where("sid < 0")).count() == 0


def test_tokens_with_and_without_what_patterns_need(spark):
    texts = ["See http://a.b/c now, ok", "wwww.x www.a.b c", "wwhttp://q w.z", "a...b c. ", "1,000 a,b 1:30 c:", "we're isn't o'clock n't 'S", "x. y.", ".", "", None, "don't; a--b (c)", "\u2028a \tb\u2028 c\u2028\u2029\nd\u0085\r\ne\u00a0f \u2029", "𝒳𝒳 a𝒳 🙂a a🙂 \u0130x x_y ½ ٣"]
    expected = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    plain = F.lower("t")
    for pattern, by in [*((x, "") for x in normalize.LINKS), *normalize.SPLITS]:
        plain = F.regexp_replace(plain, pattern, normalize._java(by))
    plain = F.filter(F.split(plain, r"\s+"), lambda w: w.rlike(normalize.TOKEN) & ~w.isin(*normalize.STOP_WORDS))
    rows = expected.select(plain.alias("a"), normalize.tokens(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(oracle.SQL)


def test_corpora_are_built_again_when_their_table_changes(spark, tmp_path):
    def put(text, mode):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode(mode).parquet(f"{tmp_path}/documents.parquet")

    put("one two", "overwrite")
    first = queries.prepared(spark, str(tmp_path))
    assert queries.prepared(spark, str(tmp_path)) is first
    put("three four five", "overwrite")
    assert [r["processed_text"] for r in queries.QUERIES["processed_text"](spark, str(tmp_path)).collect()] == ["three four five"]
    queries.release(spark)


def test_terms_within_a_sentence(spark):
    rows = C.from_processed(spark.createDataFrame([(0, "b a b c b a"), (1, "c"), (2, ""), (3, None)], "sentence_index long, processed_text string"))
    assert sorted(map(tuple, C.postings(rows).collect())) == [(0, "a", 2, 1), (0, "b", 3, 0), (0, "c", 1, 3), (1, "c", 1, 0)]
    found = {r["sid"]: sorted(map(tuple, r["terms"])) for r in C.terms(rows).collect()}
    assert found == {0: [("a", 2, 1, 1), ("b", 3, 0, 1), ("c", 1, 3, 2)], 1: [("c", 1, 0, 2)]}


def test_words_in_any_case(spark):
    rows = [(0, "Machine learning"), (1, "machine Learning fun"), (2, "other"), (3, "machine none")]
    engine = TextEngine(C.from_processed(spark.createDataFrame(rows, "sentence_index long, processed_text string")))
    plain = A.Options(filter_pos=False)
    assert {r["word"]: (r["df"], r["cooc"]) for r in engine.cluster(" MACHINE", plain).collect()} == {"learning": (2, 2), "fun": (1, 1), "none": (1, 1)}
    assert [r["sid"] for r in S.containing(engine.sentences, [" LEARNING "]).orderBy("sid").collect()] == [0, 1]
    assert [r["sid"] for r in engine.matches(engine.search("Machine")).collect()] == [0]  # the index keeps case
    assert [r["word"] for r in engine.cluster_in_path([" MACHINE"], "learning", plain).collect()] == ["fun"]
    engine.close()


def test_exclusive_scores_by_hand(spark):
    texts = ["machine learning", "machine learning great", "data great", "machine learning data", "deep networks deep"]
    engine = TextEngine(C.from_processed(spark.createDataFrame(list(enumerate(texts)), "sentence_index long, processed_text string")))

    def best(sentences, excluded=()):
        n, df = len(sentences), {}
        for t in sentences.values():
            for w in set(t.split()):
                df[w] = df.get(w, 0) + 1
        out = {}
        for k, t in sentences.items():
            scores = {w: round(t.split().count(w) * (math.log((1 + n) / (1 + df[w])) + 1) * math.log(df[w] + 1), 9) for w in set(t.split()) if df[w] >= 2 and w not in excluded}
            if scores:
                out[k] = min(scores, key=lambda w: (-scores[w], w))
        return out

    everything = dict(enumerate(texts))
    whole = best(everything)
    assert {r["sid"]: r["word"] for r in engine.exclusive().collect()} == whole
    assert {r["sid"] for r in engine.exclusive(2).collect()} == {k for k in whole if k < 2}
    inside = {k: everything[k] for k, w in whole.items() if w == "learning"}
    path = engine.exclusive_in_path([" Learning ", ""])
    assert {r["sid"]: r["word"] for r in path.collect()} == best(inside, ("learning",))
    assert engine.exclusive_in_path(["learning"]) is path and engine.exclusive() is engine.exclusive()
    with pytest.raises(ValueError, match="seed"):
        engine.exclusive_in_path(["  "])
    page = engine.cluster_sentences("LEARNING", None, 1, 1).collect()
    members = sorted(inside)
    assert [(r["sid"], r["total"], r["highlights"]) for r in page] == [(members[1], len(members), {"learning": [texts[members[1]].index("learning")]})]
    assert engine.cluster_sentences("machine", ["learning"]).count() == sum(w == "machine" for w in best(inside, ("learning",)).values())
    assert [(r["sid"], r["total"]) for r in engine.path_sentences(["learning", "data"]).collect()] == [(3, 1)]
    assert {(r["word"], r["size"]) for r in X.ranked(engine.exclusive(), size=len(members)).collect()} >= {("learning", len(members))}
    assert X.ranked(engine.exclusive(), 1, least=True).first()["size"] == min(sum(w == x for x in whole.values()) for w in whole.values())
    engine.close()


def test_engine_facade(spark, tmp_path):
    docs = datasets.from_texts(spark, ["Alpha beta. Alpha gamma!", None, 7, "beta alpha delta"])
    engine = TextEngine.from_documents(docs)
    assert engine.sentences.count() == 5
    assert [tuple(r) for r in engine.word_frequencies(2).collect()] == [("alpha", 3), ("beta", 2)]
    state = engine.search("beta", engine.search("alpha"))
    assert engine.matches(state).count() == 2 and engine.related(state, 1).first()["word"] == "alpha"
    assert "related: alpha (2), beta (2), delta (1)" in engine.described(state)
    assert sorted(r["tf"] for r in engine.posting("alpha").collect()) == [1, 1, 1] and engine.posting("zeta").count() == 0
    assert {r["word"] for r in engine.top_words(2).collect()} == {"alpha", "beta"}
    lines = [r["value"] for r in spark.read.text(engine.export_top_words(2, str(tmp_path / "top"))).collect()]
    assert sorted(line.split(":")[0] for line in lines) == ["alpha", "beta"]
    plain = A.Options(filter_pos=False)
    rows = engine.cluster_with_sentences("gamma", plain).collect()
    assert sorted((r["kind"], r["word"]) for r in rows if r["kind"] == "word") == [("word", "alpha")] and len(rows) == 2
    one = engine.cluster_by_frequency("delta", plain).collect()
    assert {(r["word"], r["n_words"]) for r in one} == {("alpha", 2), ("beta", 2)}
    assert {r["word"] for r in engine.cluster("delta", A.Options(filter_pos=False, tfidf_range=(0.0, 0.0))).collect()} == set()
    assert engine.drilled("alpha").columns == ["sid", "word"]
    engine.close()
    with pytest.raises(RuntimeError, match="disabled"):
        TextEngine.from_documents(docs, [], association_enabled=False).cluster("alpha")


def test_load_keeps_one_version_by_cap(spark, tmp_path, monkeypatch):
    path = tmp_path / "reddit.csv"
    path.write_text("body\n" + "".join(f"text number {k}\n" for k in range(12)))
    store = SentenceStore(spark, str(tmp_path / "store"))
    count = lambda cap=None: TextEngine.load(store, "reddit", str(path), cap).sentences.count()
    monkeypatch.setenv(datasets.CAP_VARIABLE, "3")
    assert count() == 3 and count(5) == 5
    monkeypatch.setenv(datasets.CAP_VARIABLE, "0")
    assert count() == 12
    monkeypatch.delenv(datasets.CAP_VARIABLE)
    assert count() == 12 and count(0) == 12 and len(store.datasets()) == 1
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("dataset_id=")]) == 1  # replaced folders are removed
    with pytest.raises(ValueError, match="negative"):
        count(-1)
    other = tmp_path / "other.csv"
    other.write_text("body\nelse\n")
    store.save("second", str(other), "1", C.dense_ids(C.sentences(datasets.read_csv(spark, str(other), datasets.get_source("reddit")))))
    assert [(e.id, e.name, e.sentence_count) for e in store.datasets()] == [(1, "reddit", 12), (2, "second", 1)]
    assert datasets.files_of(store.files, str(tmp_path), "other.csv").endswith("/other.csv") and datasets.files_of(store.files, str(tmp_path), "none.csv") is None


def test_texts_of_many_files_are_numbered_densely(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(70):
        (folder / f"{k:03}.csv").write_text("body\n" + "".join(f'"f{k} r{j}\nnext"\n' for j in range(k % 3 + 1)))
    rows = datasets.read_csv(spark, str(folder), datasets.get_source("reddit"))
    found = [(r["doc_index"], r["text"]) for r in rows.orderBy("doc_index").collect()]
    assert found == list(enumerate(f"f{k} r{j}\nnext" for k in range(70) for j in range(k % 3 + 1)))
    assert C.sentences(rows).agg(F.max("sid")).first()[0] == (len(found) - 1) * C.STRIDE


def test_legacy_database_is_taken_over(spark, tmp_path):
    old = tmp_path / "old.db"
    with sqlite3.connect(old) as con:
        con.execute("CREATE TABLE metadata (key TEXT PRIMARY KEY, value TEXT)")
        con.execute("CREATE TABLE sentences (sentence_index INTEGER, source_document_index INTEGER, original_text TEXT, processed_text TEXT)")
        con.executemany("INSERT INTO sentences VALUES (?, ?, ?, ?)", [(1, 0, "B b.", "b"), (0, 0, "A a.", "a"), (2, 1, "", "")])
        con.executemany("INSERT INTO metadata VALUES (?, ?)", [("source_path", "/data/x.csv"), ("preprocessing_version", "9")])
    store = SentenceStore(spark, str(tmp_path / "store"))
    assert store.migrate(str(old)) == 3 and store.migrate(str(old)) == 3
    (entry,) = store.datasets()
    assert (entry.name, entry.sentence_count, entry.status, entry.preprocessing_version) == ("x.csv", 3, "ready", "9")
    rows = spark.read.parquet(entry.folder).orderBy("sentence_index").collect()
    assert [(r["original_text"], r["processed_text"], r["source_document_index"]) for r in rows] == [("A a.", "a", 0), ("B b.", "b", 0), ("", "", 1)]


def test_stream_of_documents(spark, tmp_path):
    spark.createDataFrame([(0, "One two. Three!"), (1, None)], "doc_index long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_index long, text string").parquet(str(tmp_path / "in"))
    query = sentence_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(60)
    spark.createDataFrame([(2, "Four five.")], "doc_index long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    query = sentence_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(60)
    found = [(r["source_document_index"], r["processed_text"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("sid").collect()]
    assert found == [(0, "one two"), (0, "three"), (1, ""), (2, "four five")]


def test_prepared_tables(spark, tmp_path):
    texts = [f"common word{k % 7} other{k}" for k in range(500)]
    found = C.from_processed(spark.createDataFrame(list(enumerate(texts)), "sentence_index long, processed_text string"))
    tables = prepare(found, str(tmp_path / "index"))
    assert tables.of_word("common").count() == 500 and {r["sid"] for r in tables.of_word("word3").collect()} == set(range(3, 500, 7))
    assert "PartitionFilters: [isnotnull(bucket" in tables.of_word("word3")._jdf.queryExecution().toString()
    fresh, kept = ({tuple(r) for r in X.assigned(found, known=k).collect()} for k in (None, tables.terms))
    assert fresh == kept and len(kept) == 500
    plan = X.assigned(tables.sentences, known=tables.terms)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    tables.drop()


@pytest.mark.parametrize("word,kind", [("running", True), ("the", False), ("nicely", False), ("1984", False), ("cat", True)])
def test_word_classes(spark, word, kind):
    row = spark.createDataFrame([([word, "dog"],)], "ws array<string>").select(useful_words(F.col("ws")).alias("u")).first()["u"]
    assert row == ([word, "dog"] if kind else ["dog"])
