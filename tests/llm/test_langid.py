import numpy as np

from strikeloom.llm import langid, queries

PAGES = "page_id long, url string, html string, lang string, host string, total string"


def test_pages_of_the_table(spark, sf):
    rows = queries.op3_language_id(spark, sf).collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert len(rows) == pages.count()
    assert np.mean([r["lang"] == r["declared"] for r in rows]) > 0.97


def test_held_out_documents(spark, documents):
    """Text evidence alone, on documents that were not in the training sample."""
    model = langid.train(documents, 120)
    pages = documents.selectExpr("doc_id as page_id", "'' as url", "text as html")
    out = {r["page_id"]: r["text_lang"] for r in langid.identify(pages, model).collect()}
    known = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert np.mean([out[i] == known[i] for i in known]) > 0.93


def reference(pages, model):
    """The same fusion with plain loops."""
    k, n = len(model.languages), len(pages)
    post, logs = np.array([p["post"] for p in pages]), np.array([p["logs"] for p in pages])
    out = []
    for i, p in enumerate(pages):
        own = np.arange(n) != i
        p0 = (post[own].sum(axis=0) + k * (1.0 / k)) / (own.sum() + k)
        same = own & np.array([q["suffix"] == p["suffix"] for q in pages])
        p1 = (post[same].sum(axis=0) + langid.SUFFIX_MASS * p0) / (same.sum() + langid.SUFFIX_MASS)
        same = own & np.array([q["host"] == p["host"] for q in pages])
        p2 = (post[same].sum(axis=0) + langid.HOST_MASS * p1) / (same.sum() + langid.HOST_MASS)
        joint = logs[i] + np.log(p2)
        if p["declared"] is not None:
            said = np.array([q["declared"] == p["declared"] for q in pages])
            joint = joint + langid.declared_log(p["declared"], post[said].sum(axis=0), post.sum(axis=0), model.languages)
        chance = np.exp(joint - joint.max())
        out.append((p["page_id"], model.languages[int(joint.argmax())], chance.max() / chance.sum()))
    return out


def test_fusion_against_loops(spark, documents):
    model = langid.train(documents, 100)
    page = "<html lang='{}'><script>no text</script><p>{}</p></html>"
    rows = [(i, f"https://h{i % 3}.example.{'de' if i % 2 else 'org'}/x", page.format(("de", "en", "xx", "fr-FR")[i % 4], ("der und die", "the and of", "", "que les")[i % 5 % 4])) for i in range(60)]
    rows += [(100, None, None), (101, "no address", ""), (102, "http://u:p@Host.DE:80/a", "<p>und der</p>"), (None, "https://h1.example.org", "the"), (102, "http://u:p@Host.DE:80/a", "<p>und der</p>")]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)
    seen = [r.asDict() for r in langid.evidence(df, model).collect()]
    assert {r["host"] for r in seen} == {"h0.example.org", "h1.example.org", "h2.example.org", "h0.example.de", "h1.example.de", "h2.example.de", "", "host.de"}
    got = sorted(((r["page_id"], r["lang"], r["confidence"]) for r in langid.identify(df, model).collect()), key=str)
    for (i, lang, p), (j, want, q) in zip(got, sorted(reference(seen, model), key=str)):
        assert (i, lang) == (j, want) and abs(p - q) < 1e-9


def test_no_model_and_no_pages(spark, empty):
    model = langid.train(empty)
    assert model is None
    df = spark.createDataFrame([(1, "u", "h", "x", "x", "x")], PAGES)
    assert langid.identify(df, model).first()["lang"] is None


def test_empty_pages(spark, documents):
    assert langid.identify(spark.createDataFrame([], PAGES), langid.train(documents, 50)).count() == 0


def test_rare_language_is_in_the_model(frame):
    from pyspark.sql import functions as F
    rows = [(i, "the quick brown fox " * 3, "s") for i in range(3000)] + [(5000, "hyvää päivää kaikille", "s")]
    docs = frame(rows).withColumn("lang", F.when(F.col("doc_id") == 5000, "fi").otherwise("en"))
    model = langid.train(docs, 20)
    assert model.languages == ["en", "fi"] and len(set(model.logs[1])) > 1


def test_more_languages_than_a_fixed_number(frame):
    from pyspark.sql import functions as F
    rows = [(i, f"{chr(0x3041 + i % 80) * 3} {chr(0x3041 + i % 80) * 4}", "s") for i in range(400)]
    docs = frame(rows).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 80).cast("string")))
    model = langid.train(docs, 400)
    assert len(model.languages) == 80
    pages = docs.selectExpr("doc_id as page_id", "'' as url", "text as html", "lang as want")
    got = {r["page_id"]: r["text_lang"] for r in langid.identify(pages, model).collect()}
    assert all(got[i] == f"l{i % 80}" for i in range(400))


def test_markup_is_read_in_one_scan():
    import time

    assert langid.visible("a<!-- <p>x --> b <SCRIPT>y</p></script > c <style>z</style>d<br>e &amp; f < g") == "a  b   c  d e & f < g"
    assert langid.visible("1<!-- open <b>2</b> <script>3") == "1 2   3"
    assert langid.visible("<script>a<style>b</script>c</style>d") == " c d"
    assert langid.declared('<html><html x lang = "De"><meta content-language content=fr>') == "de"
    assert langid.declared("<meta http-equiv=Content-Language content='fr-CA'>") == "fr" and langid.declared("<html lang <meta>") is None
    start = time.perf_counter()
    for begin in ("<", "<!--", "<script", "<style ", "<html ", "<meta ", "</script ", "<!-- <script> "):
        page = begin * 200_000
        langid.visible(page)
        langid.declared(page)
    assert time.perf_counter() - start < 20
