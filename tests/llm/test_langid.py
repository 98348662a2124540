from symloom.llm import langid, queries


def test_languages_and_junk(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    rows = queries.op9_language_id(spark, sf_tiny)
    got = {r["doc_id"]: r for r in rows.filter("doc_id IS NOT NULL").collect()}
    assert len(got) == docs.count()
    right = sum(got[r["doc_id"]]["lang"] == r["lang"] for r in docs.collect())
    assert right >= 0.9 * len(got) and sum(r["kept"] for r in got.values()) >= 0.97 * len(got)
    assert rows.filter("page_id IS NOT NULL").count() == spark.read.parquet(f"{sf_tiny}/pages.parquet").count()


def test_text_alone_on_held_out_rows(spark, sf_tiny):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 3 > 0"))
    rest = docs.filter("doc_id % 3 = 0 AND n_chars >= 200").collect()
    hits = sum(model.codes[max(range(len(model.codes)), key=model.likelihoods(r["text"].encode())[1].__getitem__)] == r["lang"] for r in rest)
    assert hits >= 0.9 * len(rest)


def test_edges(spark):
    rows = [(1, "the and of that this", "en", "a", 1), (2, "der die und das nicht", "de", "a", 1), (3, None, "en", None, 1), (4, "", None, "b", 1), (None, "the and that", "en", "a", 1), (6, "123 456", "en", "a", 1), (6, "123 456", "en", "a", 1), (7, "the of and", "not a code", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    kept = langid.keep_known(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 7]
    assert langid.keep_known(spark, docs.limit(0)).count() == 0
    html = spark.createDataFrame([(1, "https://x.example.de/a", "<html lang='de-AT'><script>the of</script><p>der die und das"), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["lang"] for r in langid.identify(spark, langid.page_rows(html), langid.fit(docs)).collect()}
    assert got == {1: "de", 2: "und"}


def test_address_and_host_decide_where_text_does_not(spark):
    docs = spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate([("the and of that this", "en"), ("der die und das nicht", "de")] * 20)], "doc_id long, text string, lang string, source string")
    pages = [(i, f"https://h.example.org/de/{i}", "<html lang=de>der die und das nicht") for i in range(40)] + [(99, "https://h.example.org/de/99", "<html lang=de>xq")]
    got = langid.identify(spark, langid.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string")), langid.fit(docs))
    assert got.filter("page_id = 99").first()["lang"] == "de"


def test_held_out_rows_without_their_label(spark):
    """The declared label is no evidence here: fitted on two thirds of the rows, the rest is told by text and source alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = docs.filter("doc_id % 3 = 0")
    got = {r["doc_id"]: r for r in langid.identify(spark, langid.document_rows(rest.withColumn("lang", langid.F.lit(None).cast("string"))), langid.fit(docs.filter("doc_id % 3 > 0"))).collect()}
    rows = rest.filter("n_chars >= 40").collect()
    assert len(got) == rest.count()
    assert sum(got[r["doc_id"]]["lang"] == r["lang"] for r in rows) >= 0.9 * len(rows)


def test_rare_languages_have_a_class(spark):
    rows = [(n, "the and of that this with", "en") for n in range(300)] + [(1000 + n, "og ikke det som har", "no") for n in range(3)] + [(None, "x y z", "fr")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=20)
    assert model.codes == ["en", "no", "und"]
    _, ll = model.likelihoods(b"det har ikke som")
    assert max(range(3), key=ll.__getitem__) == 1


def test_registered_domains(spark):
    hosts = ["a.b.example.co.uk", "example.co.uk", "x.example.de", "com", "a.com.br", None]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "host string").select(langid.registered(langid.F.col("host"))).collect()]
    assert got == ["example.co.uk", "example.co.uk", "example.de", "com", "a.com.br", None]


def test_fit_shuffles_no_texts(spark):
    """The sample is cut by places in the order of hashes; only those travel, and it is the rows that a full sort gives."""
    from random import Random

    dice = Random(3)
    rows = [(n // 2, "".join(dice.choices("abcdefghijklmnopqrstuvwxyz ", k=8000)), ("en", "de")[n % 3 == 0]) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).localCheckpoint()
    hashed = {r["doc_id"]: (r["h"], r["doc_id"]) for r in docs.select("doc_id", langid.F.xxhash64("doc_id").alias("h")).collect()}

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        held = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        model = langid.fit(docs, train_rows=31)
        assert shuffled() - before < 500_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert model.codes == ["de", "en", "und"]
    for at, lang in enumerate(model.codes[:2]):
        own = sorted((hashed[i], text) for i, text, said in rows if said == lang)
        count = sum(langid.np.bincount(langid.trigrams(text.encode()), minlength=langid.BUCKETS) for place, text in own if place <= own[30][0])
        assert langid.np.allclose(model.logs[at], langid.np.log((count + 0.05) / (count.sum() + 0.05 * langid.BUCKETS)))
