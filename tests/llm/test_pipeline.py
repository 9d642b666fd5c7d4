import hashlib

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_repeats, check_pieces
from tidemark.llm import common, minhash, rlz, toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        before = docs.cache()
        docs = function(spark, docs, sf_dir)
        if k < 4:
            assert docs.columns == columns
            kept.append(docs.count())
            assert kept[-1] <= kept[-2] and docs.select("doc_id").distinct().count() == kept[-1]
        if name == "toxicity":
            assert toxicity.score(docs, model).filter("rejected").count() == 0
        if name == "minhash near-dedup":
            groups = minhash.near_duplicates(before)
            assert docs.count() == groups.select("component_id").distinct().count()
        if name == "substring dedup":
            assert docs.join(rlz.remove_repeats(before).filter("n_removed = n_words and n_words > 0"), "doc_id", "left_semi").count() == 0
    pieces = docs.cache()
    assert pieces.select("doc_id").distinct().count() == kept[4]
    assert pieces.groupBy("sequence_id").sum("length").filter("`sum(length)` != 2048").count() <= 1


def test_nulls_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "word " * 60, None, "s", 5)], schema)
    for docs in (odd, odd.filter("false")):
        for _, function in corpus_pipeline.STAGES:
            out = function(spark, docs, sf_dir)
            assert out.count() >= 0


def test_texts_that_share_an_id_are_judged_each(spark, sf_dir):
    prose = lambda p: " ".join(f"{p}{i}" for i in range(60))
    a, b, c = prose("a"), prose("b"), prose("c")
    rows = [(3, a, "x"), (3, b, "x"), (3, b, "w"), (1, a + " end", "x"), (7, c, "x"), (7, c + " end", "x"), (9, b, "x"), (9, None, "x"), (9, "", "x"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()]
    seven = [g for g in got if g[0] == 7]
    assert len(seven) == 1 and seven[0][1] in (c, c + " end")
    rest = [(1, a + " end", "x"), (3, b, "w"), (9, None, "x"), (9, "", "x"), (None, a, "x"), (None, a, "x")]
    assert sorted(map(str, [g for g in got if g[0] != 7])) == sorted(map(str, rest))


def plain_lines(text):
    """The lines that stay, by the two rules that the documents below meet; None where too little does."""
    lines = text.split("\n")
    good = [x for x in lines if "|" not in x and (len(x.split()) >= 8 or x.endswith("."))]
    lost = sum(len(x.split()) for x in lines if x not in good)
    return "\n".join(good) if len(text.split()) >= 50 and 2 * lost <= len(text.split()) else None


def test_each_stage_against_plain_python(spark, tmp_path):
    prose = lambda p, n=72: "\n".join(" ".join(f"{p}q{k}" for k in range(i, min(i + 12, n))) + "." for i in range(0, n, 12))
    words = [chr(97 + i // 26) + chr(97 + i % 26) + "x" for i in range(60)]
    texts = {i: prose(words[i]) for i in range(30)}
    toxic = set(range(30, 42))
    texts |= {i: prose(words[i]) + "\n" + " ".join(f"vile{c}" for c in "abcdefgh") + "." for i in toxic}
    texts |= {42: "Home | Login | About\n" + prose("m") + "\nshort stub", 43: prose("n", 20), 44: "a | b | c d e\n" * 30 + prose("o")}
    texts |= {45: texts[3].replace("q30 ", "changed "), 46: texts[3] + "\n" + texts[7], 47: None, 48: texts[5]}
    first, second = prose("r", 48), prose("s", 48)
    texts |= {49: prose("t") + "\n" + first, 50: second + "\n" + prose("u"), 51: first + "\n" + second}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = [(i, 1, int(i in toxic)) for i in [*range(25), *sorted(toxic)[:8]]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def held(frame, want):
        got = {r.doc_id: tuple(r) for r in frame.collect()}
        assert got == {i: (i, t, "en", f"s{i % 3}", len(t or "")) for i, t in want.items()}

    stages = [function for _, function in corpus_pipeline.STAGES]
    docs = stages[0](spark, docs, tmp_path).cache()
    texts = {i: t for i, t in texts.items() if i not in toxic}
    held(docs, texts)
    docs = stages[1](spark, docs, tmp_path).cache()
    texts = {i: plain_lines(t or "") for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if t is not None}
    assert not {43, 44, 47} & set(texts) and "stub" not in texts[42]
    held(docs, texts)
    docs = stages[2](spark, docs, tmp_path).cache()
    components = brute_components(list(texts.items()), 5)
    texts = {i: t for i, t in texts.items() if components[i][1] == i}
    assert not {45, 48} & set(texts)
    held(docs, texts)
    docs = stages[3](spark, docs, tmp_path).cache()
    repeats = {i: r for i, r in brute_repeats(list(texts.items()), 35).items() if r[1] == 0 or r[1] < r[0]}
    got = {r.doc_id: r for r in docs.collect()}
    assert 51 not in repeats and any(r[1] for r in repeats.values()) and got.keys() == repeats.keys()
    for i, r in got.items():
        assert hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() == repeats[i][2]
        assert (r.lang, r.source, r.n_chars) == ("en", f"s{i % 3}", len(r.text))
    check_pieces(stages[4](spark, docs, tmp_path).collect(), [(i, r.text) for i, r in got.items()], 2048)


def test_stages_leave_extra_columns_with_clashing_names_alone(spark, tmp_path):
    extra = ["grade", "rejected", "expected_severity", "kept", "clean_text", "n_words", "n_removed", "kept_text", "row", "key", "__key", "node", "first", "low", "bytes", "a.b"]
    prose = lambda p: "\n".join(" ".join(f"{p}q{k}" for k in range(i, i + 12)) + "." for i in range(0, 72, 12))
    texts = [(1, prose("a")), (2, prose("b")), (2, prose("c")), (3, prose("a")), (4, prose("d")), (4, prose("d"))]
    rows = [(i, t, "en", "s", len(t), *(f"own {i} {c}" for c in extra)) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [texts, texts, [texts[k] for k in (0, 1, 2, 4)], [texts[k] for k in (0, 1, 2, 4)]]
    for (_, function), want in zip(corpus_pipeline.STAGES, left):
        docs = function(spark, docs, tmp_path).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
        assert sorted(map(tuple, docs.collect())) == sorted((i, t, "en", "s", len(t), *(f"own {i} {c}" for c in extra)) for i, t in want)
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, tmp_path).collect()} == {1, 2, 4}


@pytest.mark.parametrize("name, function", corpus_pipeline.STAGES)
def test_texts_go_to_python_in_small_batches(spark, sf_dir, name, function):
    """A batch of 10,000 texts stood several times in the JVM, outside its heap, and in each worker."""
    docs = spark.createDataFrame([(1, "some words " * 60, "s")], "doc_id long, text string, source string")
    texts = spark.range(0, 3000, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(" word" * 1000)).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    try:
        spark.conf.unset(common.BATCH)
        function(spark, docs, sf_dir)
        found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 12_000_000 and max(found) < 5_000_000
        spark.conf.set(common.BATCH, "1m")
        function(spark, docs, sf_dir)
        assert spark.conf.get(common.BATCH) == "1m"
    finally:
        spark.conf.unset(common.BATCH)
