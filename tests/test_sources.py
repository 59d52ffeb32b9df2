"""Files, stored mappings, settings and streams."""

import io
import zipfile

import pytest

from veilmark.operators import lists, overrides, pipeline, store
from veilmark.operators.pipeline import Settings
from veilmark.sources import configs, documents, readers, sinks
from veilmark.streaming.detect import anonymise_stream, write_with_mapping

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


BODY = """<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Ti</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>tle A&amp;B</w:t></w:r></w:p>
<w:p><w:r><w:t>Ann</w:t><w:br/><w:t xml:space="preserve"> Lee</w:t><w:tab/></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"""


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(BODY))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in readers.dispatch(spark, str(tmp_path / "a.docx")).collect()}
    assert got["a.docx"] == "Title A&B\nAnn\n Lee\t\ncell\nHead"
    assert {r.text is None for r in documents.docx_texts(spark, str(tmp_path)).collect()} == {True, False}
    assert [r.kind for r in documents.docx_segments(spark, str(tmp_path / "a.docx")).filter("para = 1").orderBy("seg").collect()] == ["wt", "br", "wt", "tab"]
    assert documents.docx_text(documents.replace_in_docx(docx(BODY), [("Title", "<X_1>"), ("Ann\n Lee", "<Ann\n Lee_1>")])).startswith("<X_1> A&B\n<Ann\n Lee_1>\t")
    assert documents.to_html(docx(BODY)).startswith("<h1>Ti<b>tle A&amp;B</b></h1>")


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.csv").write_text("x,y")
    (tmp_path / "c.bin").write_text("z")
    assert sorted(r.text for r in readers.text_files(spark, str(tmp_path)).collect()) == ["one\ntwo", "x,y"]
    assert readers.find_files(spark, str(tmp_path), "*.txt").count() == 1
    with pytest.raises(ValueError):
        readers.dispatch(spark, str(tmp_path / "c.bin"))


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("s1", {"<D2_PERSON_1>": "Ann"})], "session_id string, mapping map<string, string>")
    store.save(store.long_mapping(df), str(tmp_path / "m"))
    row = store.load_mapping(spark, str(tmp_path / "m"), "s1").first()
    assert (row.type, row.original) == ("D2_PERSON", "Ann") and store.load_mapping(spark, str(tmp_path / "m"), "no").count() == 0
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "session_id string, ts int")
    assert {(r.session_id, r.ts) for r in store.latest(t).collect()} == {("a", 2), ("b", 1)}


def test_settings(monkeypatch, spark):
    p = configs.Profile.from_json('{"name": "n", "base_domain": "legal", "extra_stoplist": ["Foo"], "custom_patterns": [{"name": "c", "pattern": "C[0-9]"}, {"name": "x"}], "more": 1}')
    assert p.settings().min_score == 0.5 and p.settings({"min_score": 0.6}).min_score == 0.6 and len(p.settings().custom) == 1 and p.settings().extra_stop == ("foo",)
    monkeypatch.setenv("VEILMARK_MIN_SCORE", "0.7")
    assert p.settings({"min_score": 0.6}).min_score == 0.7
    with pytest.raises(ValueError):
        configs.Profile.from_json("{}")
    lines = spark.createDataFrame([(" A ",), ("# b",), ("",), ("a",)], "value string")
    assert [r.term for r in lists.parse_lines(lines).collect()] == ["a"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "to a@b.co now"), (2, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = write_with_mapping(anonymise_stream(docs, Settings(types=("EMAIL_ADDRESS",))), str(tmp_path / "out"), str(tmp_path / "map"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id: r.anonymized_text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "to <EMAIL_1> now", 2: "nothing"}
    assert [r.original for r in spark.read.parquet(str(tmp_path / "map")).collect()] == ["a@b.co"]


LETTER = """<w:p><w:r><w:t>From Dr Ann</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve"> Lee, mail </w:t></w:r><w:r><w:t>ann@x</w:t><w:t>.org</w:t></w:r></w:p>
<w:p><w:r><w:t>bob@y.org</w:t><w:tab/><w:t>and ann@x.org</w:t></w:r></w:p><w:p><w:r><w:t>sent to Acme</w:t></w:r></w:p><w:p><w:r><w:t>Trading</w:t></w:r></w:p><w:p><w:r><w:t>Ltd of London</w:t><w:cr/></w:r></w:p>"""


def test_docx_flow(spark, tmp_path):
    """Found by paragraph, numbered over the document from right to left in a paragraph, replaced over runs, written as files and restored."""
    (tmp_path / "a.docx").write_bytes(docx(LETTER))
    (tmp_path / "b.docx").write_bytes(docx("<w:p/>"))
    files = documents.docx_files(spark, str(tmp_path))
    how = Settings(types=("EMAIL_ADDRESS",), finders=tuple((n, configs.FINDERS[n]) for n in ("rules", "gazetteer")))
    done = documents.anonymise_docx(files, how)
    got = {r.path.rsplit("/", 1)[-1]: r for r in done.collect()}
    new = documents.docx_text(bytes(got["a.docx"].content))
    assert new.split("\n")[:2] == ["From Dr <PERSON_1>, mail <EMAIL_1>", "<EMAIL_2>\tand <EMAIL_1>"] and "Ltd of <LOCATION_1>\r" in new
    assert got["a.docx"].mapping == {"<PERSON_1>": "Ann Lee", "<EMAIL_1>": "ann@x.org", "<EMAIL_2>": "bob@y.org", "<LOCATION_1>": "London"} and got["b.docx"].mapping == {}
    back = {r.path.rsplit("/", 1)[-1]: documents.docx_text(bytes(r.content)) for r in documents.replaced_docx(done, restore=True).collect()}
    assert back["a.docx"] == documents.docx_text(docx(LETTER))
    again = documents.replaced_docx(files.join(done.select("doc_id", "mapping"), "doc_id"))
    assert documents.docx_text(bytes(again.filter("path LIKE '%a.docx'").first().content)) == new
    out = done.select("path", "content").withColumn("session_id", documents.F.lit("s1")).withColumn("file_name", sinks.output_name("path"))
    wrote = sinks.write_files(out, str(tmp_path / "out")).collect()
    assert sorted(r.path.rsplit("/", 2)[-1] for r in wrote) == ["a_anonymized.docx", "b_anonymized.docx"]
    assert documents.docx_text((tmp_path / "out" / "veilmark_s1" / "a_anonymized.docx").read_bytes()) == new


def test_over_paragraphs():
    data = documents.replace_in_docx(docx(LETTER), [("Acme\nTrading\nLtd", "<ORG_1>"), ("missing\nvalue", "<X>"), ("ann@x.org", "<EMAIL_1>")])
    assert documents.docx_text(data).split("\n")[2:5] == ["sent to <ORG_1>", "", " of London\r"]


def test_pdf_joins_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"first page of the text|of a file with over fifty characters")
    (tmp_path / "b.pdf").write_bytes(b"short")
    (tmp_path / "c.pdf").write_bytes(b"!")

    def pages(data):
        if data == b"!":
            raise ValueError("no such file")
        return [*data.decode().split("|"), None]

    got = {r.path[-5:]: (r.text, r.error) for r in readers.dispatch(spark, str(tmp_path / "a.pdf"), pages).unionByName(readers.pdf_texts(spark, str(tmp_path / "*.pdf"), pages)).collect()}
    assert got["a.pdf"] == ("first page of the text\nof a file with over fifty characters\n", None)
    assert got["b.pdf"] == (None, "under 50 characters of text") and got["c.pdf"] == (None, "no such file")
    with pytest.raises(NotImplementedError):
        readers.dispatch(spark, str(tmp_path / "a.pdf"))


def test_sessions_and_names(spark, tmp_path):
    where = str(tmp_path / "m")
    sinks.replace_sessions(spark.createDataFrame([("s1", "a"), ("s2", "b")], "session_id string, v string"), where)
    sinks.replace_sessions(spark.createDataFrame([("s1", "c")], "session_id string, v string"), where)
    assert {(r.session_id, r.v) for r in spark.read.parquet(where).collect()} == {("s1", "c"), ("s2", "b")}
    names = spark.createDataFrame([("/x/one.v2.txt",), ("s3://b/two.pdf",), ("three",)], "path string").select(sinks.output_name("path").alias("n")).collect()
    assert [r.n for r in names] == ["one.v2_anonymized.txt", "two_anonymized.txt", "three_anonymized"]
    assert sinks.write_files(spark.createDataFrame([("s", "t.txt", "é"), ("s", "u.txt", None)], "session_id string, file_name string, content string"), f"file://{tmp_path}/o").first().n_bytes == 2


def test_learned_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"general": ["Foo"], "legal": ["bar", "foo"], "financial": ["no"]}')
    (tmp_path / "b.json").write_text("[oops")
    assert {r.term for r in lists.in_scope(lists.read_learned(spark, str(tmp_path)), "legal").collect()} == {"foo", "bar"}


def test_profiles(tmp_path):
    where = str(tmp_path / "profiles")
    assert configs.list_profiles(where) == []
    configs.save_profile(where, configs.Profile("My firm/1", base_domain="legal", extra_stoplist=["A", "B"], finders=["rules"]))
    configs.save_profile(where, configs.Profile("Aa"))
    configs.save_profile(where, configs.Profile("Aa", description="new"))
    (tmp_path / "profiles" / "broken.json").write_text("{")
    assert [(p["name"], p["terms"], p["description"]) for p in configs.list_profiles(where)] == [("Aa", 0, "new"), ("My firm/1", 2, "")]
    loaded = configs.load_profile(where, "My firm/1").settings()
    assert loaded.domain == "legal" and [n for n, _ in loaded.finders] == ["rules"] and loaded.context is not None and configs.Profile("x", context=False).settings().context is None
    assert configs.delete_profile(where, "My firm/1") and not configs.delete_profile(where, "My firm/1")


def test_reapply(spark):
    docs = pipeline.detect(spark.createDataFrame([(i, "to a@b.co and c@d.co, Acme") for i in range(5)], "doc_id long, text string"), Settings(types=("EMAIL_ADDRESS",)))
    reviews = spark.createDataFrame([(0, "approved", '{"remove": [0], "add": [{"text": "Acme", "type": "ORGANIZATION"}]}'), (1, "pending", '{"remove": [0]}'), (2, "approved", "{oops"), (3, "approved", '{"remove": [7]}')], "doc_id long, status string, overrides string")
    got = {r.doc_id: [s["text"] for s in r.spans] for r in overrides.reapply(docs, reviews).collect()}
    assert got[0] == ["c@d.co", "Acme"] and all(got[i] == ["a@b.co", "c@d.co"] for i in (1, 2, 3, 4))
    assert pipeline.anonymise(overrides.reapply(docs, reviews)).filter("doc_id = 0").first().anonymized_text == "to a@b.co and <EMAIL_1>, <ORG_1>"


def test_sql_functions(spark):
    from veilmark.functions.sql import register

    register(spark)
    assert spark.sql("SELECT pii_valid_isin('US0378331005'), pii_valid_lei('x'), pii_valid_ssn('666-12-1234')").first() == (True, False, False)
    assert [s["text"] for s in spark.sql("SELECT pii_spans('mail a@b.co') AS s").first().s if s["type"] == "EMAIL_ADDRESS"] == ["a@b.co"]
    assert spark.sql("SELECT text FROM pii_find('mail a@b.co') WHERE type = 'EMAIL_ADDRESS'").first().text == "a@b.co"
    assert spark.sql("SELECT count(*) FROM pii_types JOIN pii_recognisers USING (type)").first()[0] >= 70 and spark.sql("SELECT * FROM pii_stop_terms WHERE term = 'client'").count() == 1
