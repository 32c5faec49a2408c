"""The composed operators, office readers, and parts that no other test reaches."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docmill.functions import adapters, markup, office
from docmill.functions import text as X
from docmill.functions import values as V
from docmill.operators import answer, crawl, ingest, laws, load, register, retrieval
from docmill.sources import tables
from docmill.streaming import incremental

W, S, P, R = (f'xmlns:{k}="urn:{k}"' for k in "wspr")


def archive(**parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return bytearray(raw.getvalue())


def docx():
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}{p('c')}</w:tc></w:tr><w:tr><w:tc>{p('d')}</w:tc><w:tc>{p('')}</w:tc></w:tr></w:tbl>"
    return archive(**{"word__document.xml": f"<w:document {W}><w:body>{p('First', ' part')}{table}{p('  ')}{p('Last &amp; end')}</w:body></w:document>"})


def xlsx():
    book = f'<s:workbook {S} {R}><s:sheets><s:sheet name="One" r:id="r1"/><s:sheet name="None" r:id="r2"/><s:sheet name="Two" r:id="r3"/></s:sheets></s:workbook>'
    rels = "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2, 3)) + "</Relationships>"
    one = f'<s:worksheet {S}><s:sheetData><s:row r="1"><s:c r="A1" t="s"><s:v>0</s:v></s:c><s:c r="C1" s="1"><s:v>43831.5</s:v></s:c></s:row><s:row r="2"/><s:row r="3"><s:c r="B3" t="b"><s:v>1</s:v></s:c><s:c r="C3"><s:v>2.50</s:v></s:c></s:row></s:sheetData></s:worksheet>'
    two = f'<s:worksheet {S}><s:sheetData><s:row><s:c t="inlineStr"><s:is><s:t>in line</s:t></s:is></s:c></s:row></s:sheetData></s:worksheet>'
    styles = f'<s:styleSheet {S}><s:numFmts><s:numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></s:numFmts><s:cellXfs><s:xf numFmtId="0"/><s:xf numFmtId="170"/></s:cellXfs></s:styleSheet>'
    shared = f"<s:sst {S}><s:si><s:r><s:t>Ri</s:t></s:r><s:r><s:t>ch </s:t></s:r></s:si></s:sst>"
    return archive(**{"xl__workbook.xml": book, "xl___rels__workbook.xml.rels": rels, "xl__worksheets__sheet1.xml": one, "xl__worksheets__sheet2.xml": f"<s:worksheet {S}><s:sheetData/></s:worksheet>", "xl__worksheets__sheet3.xml": two, "xl__styles.xml": styles, "xl__sharedStrings.xml": shared})


def pptx():
    text = lambda *lines: "<p:txBody>" + "".join(f"<p:p><p:r><p:t>{x}</p:t></p:r></p:p>" for x in lines) + "</p:txBody>"
    shape = lambda body, mark="": f"<p:sp><p:nvSpPr><p:nvPr>{mark}</p:nvPr></p:nvSpPr>{body}</p:sp>"
    table = f"<p:graphicFrame><p:tbl><p:tr><p:tc>{text('x')}</p:tc><p:tc>{text('y', 'z')}</p:tc></p:tr></p:tbl></p:graphicFrame>"
    group = f"<p:grpSp>{shape(text('in group'))}<p:grpSp>{shape(text('too deep'))}</p:grpSp></p:grpSp>"
    slide = lambda *shapes: f"<p:sld {P}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
    show = f'<p:presentation {P} {R}><p:sldIdLst><p:sldId r:id="a"/><p:sldId r:id="b"/></p:sldIdLst></p:presentation>'
    rels = '<Relationships><Relationship Id="a" Target="slides/slide2.xml"/><Relationship Id="b" Target="/ppt/slides/slide1.xml"/></Relationships>'
    first = slide(shape(text("body", "", "more")), shape(text("Title"), '<p:ph type="ctrTitle"/>'), table, group)
    return archive(**{"ppt__presentation.xml": show, "ppt___rels__presentation.xml.rels": rels, "ppt__slides__slide2.xml": first, "ppt__slides__slide1.xml": slide(shape(text(" ")))})


DOCX = "First part\n\nLast & end\n\na | b\nc\nd | "
XLSX = [(1, "One", "[Sheet: One]\n\nRich |  | 2020-01-01 12:00:00\n | True | 2.50"), (3, "Two", "[Sheet: Two]\n\nin line")]
PPTX = [(1, None, "# Title\n\nbody\nmore\n\nx | y z\n\nin group")]


def test_office_pages(spark):
    rows = [("docx", docx()), ("xlsx", xlsx()), ("pptx", pptx()), ("docx", bytearray(b"no zip")), ("xlsx", archive(other="x")), ("pptx", None), ("pdf", docx())]
    df = spark.createDataFrame(list(enumerate([r[1] for r in rows])), "i int, content binary").join(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, kind string"), "i")
    got = {r.i: r.p and [tuple(x) for x in r.p] for r in df.select("i", office.pages_by(F.col("content"), F.col("kind")).alias("p")).collect()}
    assert got == {0: [(1, None, DOCX)], 1: XLSX, 2: PPTX, 3: None, 4: None, 5: None, 6: None}
    with pytest.raises(ValueError):
        office.pages(F.col("content"), "odt")


def test_ingest_end_to_end(spark):
    long = "\n\n".join(f"paragraph {i} " + "w " * 200 for i in range(100))
    files = [
        ("s/a.txt", bytearray(b"one two\n\nthree"), "text"), ("s/long.txt", bytearray(long.encode()), "text"), ("s/b.docx", docx(), "docx"), ("t/c.xlsx", xlsx(), "xlsx"), ("t/empty.txt", bytearray(b"  "), "text"),
        ("t/d.pdf", bytearray(b"%PDF"), "pdf"), ("t/e.bin", bytearray(b"x"), None), ("s/old.txt", bytearray(b"new words"), "text"),
    ]
    df = spark.createDataFrame(files, "storage_path string, content binary, processor string")
    stored = spark.createDataFrame([("s/old.txt", "id0", "old words"), ("s/other.txt", "id1", "kept")], "storage_path string, chunk_id string, chunk_text string")
    table, outcomes = load.ingested(df, stored)
    got = {r.storage_path: (r.outcome, r.chunks, r.batches) for r in outcomes.collect()}
    n = got["s/long.txt"][1]
    assert n > 10 and got == {
        "s/a.txt": ("processed", 1, 1), "s/long.txt": ("processed", n, 1), "s/b.docx": ("processed", 1, 1), "t/c.xlsx": ("processed", 2, 1), "t/empty.txt": ("deleted", 0, 0), "t/d.pdf": ("deleted", 0, 0), "t/e.bin": ("deleted", 0, 0),
        "s/old.txt": ("processed", 1, 1),
    }
    rows = table.collect()
    assert {(r.storage_path, r.chunk_text) for r in rows if r.storage_path in ("s/old.txt", "s/other.txt", "t/c.xlsx")} == {("s/old.txt", "new words"), ("s/other.txt", "kept"), ("t/c.xlsx", XLSX[0][2]), ("t/c.xlsx", XLSX[1][2])}
    assert len({r.chunk_id for r in rows}) == len(rows) == 6 + n
    again = {r.storage_path: r.outcome for r in load.ingested(df, table, overwrite=False)[1].collect()}
    assert {k for k, v in again.items() if v == "skipped"} == {"s/a.txt", "s/long.txt", "s/b.docx", "t/c.xlsx", "s/old.txt"}
    assert load.ingested(df.limit(0), stored)[1].count() == 0


def page(title, body):
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


def article(num, text):
    return f"<div class='bodyTesto'><h2 class='article-num-akn'>{num}</h2><div class='art-comma-div-akn'>{text}</div></div>"


def test_laws_by_three_ways(spark):
    base = "https://host.example"
    xml = "<akn xmlns='urn:x'><article><num>Art. 1</num><p>By XML</p></article></akn>"
    loaders = "<a onclick=\"showArticle('/atto/caricaArticolo?n=1')\"></a><a onclick=\"showArticle('/atto/caricaArticolo?n=2')\"></a><a onclick=\"showArticle('/atto/caricaArticolo?n=1')\"></a>"
    fetched = [
        (f"{base}/1", page("Law 1", "<A HREF='/xml?caricaAKN=1'>x</A>" + article("Art. 9", "own"))), (f"{base}/xml?caricaAKN=1", xml), (f"{base}/2", page("Law 2", loaders + article("Art. 9", "own"))),
        (f"{base}/atto/caricaArticolo?n=1", article("Art. 1", "one")), (f"{base}/atto/caricaArticolo?n=2", article("Art. 2", "two")), (f"{base}/3", page("Law 3", "<!-- <a href='/caricaAKN'> -->" + article("Art. 9", "own"))),
        (f"{base}/4", page("Law 4", laws.NOT_PUBLISHED)), (f"{base}/5", page("Law 5", "nothing")), (f"{base}/6", page("Law 6", article("Art. 1", "six"))),
    ]
    df = spark.createDataFrame(fetched, "url string, body string")
    entries = spark.createDataFrame([("l", i, f"{base}/{i}", f"Decreto {i} marzo 2024, n. {i}", "tax" if i != 6 else "sport") for i in range(1, 9)], "lane string, pos int, url string, title string, subtitle string")
    found = {r.pos: [tuple(a) for a in r.articles or ()] for r in laws.articles(entries, df).collect()}
    assert found == {1: [("Art. 1", "Art. 1By XML")], 2: [("Art. 1", "one"), ("Art. 2", "two")], 3: [("Art. 9", "own")], 5: [], 6: [("Art. 1", "six")]}
    stored = spark.createDataFrame([(f"{base}/8", None), (None, "dlgs_07_marzo_2024_n_7.txt")], "url string, file string")
    files, counts = laws.relevant_laws(entries, stored, df, lambda s: F.when(s == "tax", '{"relevant": true}').otherwise("no"))
    got = {r.pos: r.text for r in files.collect()}
    assert set(got) == {1, 2, 3}
    assert got[2] == f"url: {base}/2\ntitle: Decreto 2 marzo 2024, n. 2\nsubtitle: tax\n\n---\n\nLaw 2\n\nArt. 1\none\n\nArt. 2\ntwo\n"
    assert counts.first().asDict() == {"total_found": 8, "total_checked": 6, "relevant_count": 5, "files_saved": 3}


def test_answers(spark):
    schema = "request_id int, conv_id int, message string, attachments string, image_texts array<string>, tone string"
    requests = spark.createDataFrame([(1, 1, "hello", None, [], "Kind."), (2, 2, "again", "file", ["a cat"], None), (3, 3, "judge fails", None, [], None)], schema)
    messages = spark.createDataFrame([(2, 1, "user", "hi"), (2, 2, "assistant", "yes"), (2, 3, "system", "hidden"), (3, 1, "user", "x")], "conv_id int, turn int, role string, text string")
    documents = spark.createDataFrame([(1, 2, "b", "two"), (1, 1, "a", "one"), (2, 1, "c", "not shown")], "request_id int, rank int, name string, text string")
    judge = lambda text: F.when(F.contains(text, F.lit("again")), '{"retrieve": false}')
    seen = lambda prompt: F.concat(prompt, F.lit(" cite9\nrest"))
    out = {r.request_id: r for r in answer.answered(requests, messages, documents, judge, seen).collect()}
    assert [out[i].retrieve for i in (1, 2, 3)] == [True, False, True] and [out[i].n_documents for i in (1, 2, 3)] == [2, 0, 0]
    assert out[1].prompt.startswith("Answer from the documents given. Kind.\n\n<<<Knowledge Base>>>\n<Documento n.1") and out[1].prompt.endswith("two\n\nhello")
    assert out[2].prompt == "Answer from general knowledge.\n\nuser: hi\nassistant: yes\n\n<<<Allegati dell'utente>>>\nfile\n\nagain\n\na cat"
    assert out[1].answer == out[1].prompt + "  \nrest"
    drafts = spark.createDataFrame([(2, "m", "t", "{}"), (9, "m", "t", "{}")], "conv_id int, message string, template string, requirements string")
    wrote = {r.conv_id: (r.refined, r.prompt) for r in answer.written(drafts, messages).collect()}
    assert wrote == {2: (True, f"{answer.REFINE}\n\nuser: hi\nassistant: yes\n\nt\n\n{{}}\n\nm"), 9: (False, f"{answer.WRITE}\n\nt\n\n{{}}\n\nm")}


def test_links_of_every_spelling(spark):
    html = """<A HREF='/one?a=1&amp;b=2'>One</A> <a class=x href=/two>2</a><link href="/style.css"><!-- <a href="/hidden"> --><script>var x = '<a href="/script">';</script><a name="top">no</a><a
      href = "/three" >3</a><a href="">self</a>"""
    df = spark.createDataFrame([(html,), (None,)], "html string")
    assert [r.h for r in df.select(markup.hrefs(F.col("html")).alias("h")).collect()] == [["/one?a=1&b=2", "/two", "/three", ""], None]


def test_plain_sources(spark, tmp_path):
    (tmp_path / "caps.csv").write_text("cap_code;comune\n41121;Modena\n001xx;Roma\n")
    assert [tuple(r) for r in tables.postal_codes(spark, str(tmp_path / "caps.csv")).collect()] == [("41121", "Modena"), ("001xx", "Roma")]
    with pytest.raises(Exception, match="(?i)driver|No suitable"):
        tables.messages(spark, "jdbc:none://host/db", "messages")


def test_small_predicates_and_projections(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [value(crawl.not_found(F.lit(t))) for t in ("Pagina NON TROVATA", "Notizie")] == [True, False]
    assert [value(crawl.is_category(F.lit(t))) for t in ("/docs/12-leggi-tributi", "/docs/leggi", "/docs/12-leggi?x")] == [True, False, False]
    assert [value(crawl.followed(F.lit(u), "https://h.it", crawl.follow_resolution)) for u in ("https://h.it/risoluzioni/1", "https://k.it/risoluzioni/1", "https://h.it/altro")] == [True, False, False]
    assert [value(ingest.source_hint(F.lit(t))) for t in ("a/b/c", "a")] == ["a", None]
    assert [value(laws.not_published(F.lit(t))) for t in (f"x {laws.NOT_PUBLISHED} y", "x")] == [True, False]
    assert value(X.target_path(F.lit("a"), F.lit(None).cast("string"), F.lit("b.pdf"))) == "a/b.pdf" and value(X.one_space(F.lit(" a \t b\n"))) == "a b"
    assert [value(V.is_image_attachment(F.lit(k), F.lit(n))) for k, n in (("IMAGE/png", "x"), (None, "y.webp"), ("text/csv", "z.csv"))] == [True, True, False]
    assert [value(V.is_text_attachment(F.lit(k), F.lit(n))) for k, n in (("text/csv", "x"), (None, "y.md"), ("image/png", "z.png"))] == [True, True, False]
    assert value(markup.with_header(F.lit("u"), F.lit("t"), F.lit("s"), F.lit("b"))) == "url: u\ntitle: t\nsubtitle: s\n---\nb"
    assert value(adapters.law_text(F.array().cast("array<string>"), F.lit(None).cast("array<string>"), F.array(F.lit("x")))) == ["x"]
    assert value(V.json_bytes(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"), F.lit("è").alias("c"))) == len('{"a": 1, "b": null, "c": "è"}'.encode())
    assert value(adapters.describable(F.lit("image/PNG"), F.lit(bytearray(b"x")))) and not value(adapters.describable(F.lit("image/tiff"), F.lit(bytearray(b"x"))))
    assert len(value(adapters.embed(F.array(F.lit("a b"), F.lit(""))))) == 2
    hits = retrieval.hit_columns(spark.createDataFrame([("c1", None, 0.5)], "chunk_id string, chunk_text string, score double"))
    assert hits.first().asDict() == {"chunk_id": "c1", "chunk_text": "", "score": 0.5, "page": None, "library": None, "doc_name": "", "storage_path": "", "source": None}


def test_rerank_and_pages_of_a_category(spark):
    rows = spark.createDataFrame([(1, "tax law"), (2, "tax"), (3, "sport"), (4, "law tax law")], "pos int, text string")
    assert [r.pos for r in adapters.rerank(rows, "tax law", 3).collect()] == [1, 4, 2]
    listing = spark.createDataFrame([("c", i, n) for i, n in enumerate((3, 0, 2, 0, 0, 5))], "category string, page int, n_new int")
    assert sorted(r.page for r in ingest.stop_after_idle(listing, "category", "page").collect()) == [0, 1, 2, 3, 4]
    page = '<ul><li class="pager next"><a href="/list?page=2">2</a></li></ul>'
    assert spark.createDataFrame([(page,)], "h string").select(markup.next_page(F.col("h")).alias("n")).first().n == "/list?page=2"


def test_article_cards_and_details(spark):
    listing = """<div class="aprev big"><span class="meta-part subsection">Temi</span><h3 class="aprev-title"><a href="/art/x-1">A long enough title</a></h3><p class="aprev-excerpt">Opening.</p><p class="auth">di Anna e Carlo</p>
      <time class="time" datetime="2024-05-06">6 maggio</time><div class="aprev-rel-item"><a href="/art/y">Related piece</a><a href="/z">tiny</a></div></div>
      <div class="archcard"><h3>Archived long title</h3><p>First paragraph</p><a href="#top">x</a></div><div class="aprev"><h3 class="aprev-title">short</h3></div><div class="aprev"><h3 class="aprev-title">A long enough title</h3></div>"""
    page = '<h1>Main</h1><h2 class="asummary">Sub</h2><p class="atabs-txt">Other</p><span class="subsection">Sec</span><p class="byline">di Anna RossieCarlo</p><time>oggi</time>'
    rows = spark.createDataFrame([(1, listing), (2, page), (3, "<h1>Pagina non trovata</h1>"), (4, None)], "i int, html string")
    out = {r.i: r for r in rows.select("i", markup.article_cards("html").alias("c"), markup.article_details("html").alias("d")).collect()}
    assert [tuple(c) for c in out[1].c] == [
        ("A long enough title", "Temi", "Opening.", "di Anna e Carlo", "2024-05-06", "/art/x-1", ["Related piece"]), ("Archived long title", None, "First paragraph", None, None, None, None),
    ]
    assert tuple(out[2].d) == ("Main", "Sub", "Other", "Sec", "di Anna RossieCarlo", "oggi")
    assert out[3].d.title is None and out[4].d.title is None and out[4].c is None


def test_register_by_place(spark):
    box = """<div id="main-content"><h2><i class="fa fa-user"></i> Iscritto  ROSSI ANNA</h2><div class="box-avvisi row row-evento"><div><p>Ordine di: Modena</p></div><div><p>Nato a: Roma il: 01/02/1970</p><p>Titolo professionale: Dottore</p><p>Revisore contabile: Si</p></div>
      <div><p>Data anzianità: 03/04/2000</p><p>Iscritto all'Albo: 05/06/2001</p><p>Sezione: A</p></div><div><strong><i class="fa fa-map-marker"></i> VIA ROMA 17 <b>41121</b> (MO) <i class="fa fa-phone"></i> 059 551605 <br/></strong></div></div><p>Data ultima modifica: 07/08/2020</p></div>"""
    plain = "<p>Iscritto: BIANCHI CARLO</p><p>Ordine di: Roma</p><p>Sede studio: Via Po 1</p>"
    rows = spark.createDataFrame([(1, box), (2, plain), (3, None)], "i int, html string")
    out = {r.i: r.asDict() for r in register.page_records(rows).collect()}
    want = {"nome_completo": "ROSSI ANNA", "luogo_nascita": "Roma", "data_nascita": "01/02/1970", "ordine": "Modena", "data_anzianita": "03/04/2000", "titolo_professionale": "Dottore", "revisore_contabile": "Si", "data_iscrizione": "05/06/2001", "sezione": "A", "sede_studio": "VIA ROMA 17 41121 (MO)", "telefono": "059551605", "data_modifica": "07/08/2020"}
    assert {k: out[1][k] for k in want} == want
    assert (out[2]["nome_completo"], out[2]["ordine"], out[2]["sede_studio"], out[2]["telefono"]) == ("BIANCHI CARLO", "Roma", "Via Po 1", "")
    assert out[3]["nome_completo"] in ("", None)


def test_any_number_of_dots(spark):
    deep = "https://h/" + "a/" * 12 + "x.html"
    cases = [("../" * 12 + "y.pdf", deep, "https://h/y.pdf"), ("./z", deep, "https://h/" + "a/" * 12 + "z"), ("/p/./q/../r?x=../s", deep, "https://h/p/r?x=../s"), ("..", "https://h/a/b/c", "https://h/a/"), ("https://k/plain", deep, "https://k/plain")]
    df = spark.createDataFrame(cases, "href string, page string, want string")
    for r in df.select("*", X.absolute(F.col("href"), F.col("page")).alias("got")).collect():
        assert r.got == r.want


def test_marks_and_model_files(spark, tmp_path):
    mark = str(tmp_path / "mark")
    assert tables.read_mark(spark, mark) is None
    for key in ("k1", "k2"):
        tables.write_mark(spark, mark, key)
    listing = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "key string, pos int")
    assert [r.key for r in ingest.resumed(listing, "key", tables.read_mark(spark, mark), "pos").orderBy("pos").collect()] == ["k2", "k3"]
    files = spark.createDataFrame([("a", "x"), ("b", " "), ("c", "bad"), ("d", "old")], "storage_path string, text string")
    out = adapters.answered_files(files, files.where("text = 'old'"), lambda t: F.when(t != "bad", F.upper(t)))
    assert {r.storage_path: (r.output, r.status) for r in out.collect()} == {"a": ("X", "success"), "b": ("", "success"), "c": (None, "error")}


def test_batches_are_sent_again(spark, tmp_path):
    schema = "i int"
    for k in range(2):
        spark.createDataFrame([(k,)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tries: list[int] = []

    def send(df):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("once")
        if df.where("i = 1").count():
            raise RuntimeError("always")
        df.write.mode("append").parquet(str(tmp_path / "out"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.delivered(stream, send, str(tmp_path / "failed"), str(tmp_path / "state")).awaitTermination()
    assert [r.i for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [0]
    assert [(r.i, r.error) for r in spark.read.parquet(str(tmp_path / "failed")).collect()] == [(1, "always")]


def test_register_pages_are_read_once(spark):
    """A filter on what was read isn't moved below the reading, which would then be done twice."""
    pages = spark.createDataFrame([(1, "<p>Nothing</p>")], "id int, html string")
    plan = register.built(pages, "html", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("register_box(") == 1


def test_vectors_are_made_in_bounded_batches(spark):
    from docmill.operators import chunking

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(64 << 20))
        got = chunking.chunked(spark.createDataFrame([(1, "a b\n\nc d")], "id int, text string")).collect()
        assert [r.chunk for r in got] == ["a b\n\nc d"] and int(spark.conf.get(name)) <= tables.BATCH_BYTES
    finally:
        spark.conf.set(name, before)
