import unicodedata

import pytest
from pyspark.sql import functions as F

from docmill.functions import adapters, markup
from docmill.functions import text as X
from docmill.functions import values as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'binary' if isinstance(v, bytes) else 'int'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


C = F.col


def cases():
    return [
        (X.tokens(C("t")), {"t": "Perché no, A-1?"}, ["perch", "no", "a", "1"]),
        (X.estimate_down(C("t")), {"t": "a b c d"}, 3), (X.estimate_up(C("t")), {"t": "a b c"}, 4), (X.estimate_cost(C("t")), {"t": "a b c"}, 2),
        (X.slug_hyphen(C("t")), {"t": " Città è 100% "}, "citta-e-100"), (X.slug_hyphen(C("t")), {"t": "日本"}, "documento"),
        (X.slug_underscore(C("t")), {"t": " È un Caso "}, "un_caso"), (X.slug_safe(C("t")), {"t": "__"}, "item"),
        (X.name_article(C("t")), {"t": 'a<b>:"c  d_'}, "a_b_c_d"), (X.name_foundation(C("t")), {"t": "..a//b. "}, "a_b"), (X.name_order(C("t")), {"t": ' a?"b._'}, "a_b"),
        (X.name_law(C("t")), {"t": "è"}, "untitled"), (X.name_notary(C("t")), {"t": " a:b   c "}, "a_b c"), (X.name_export(C("t")), {"t": "Forlì/Cesena x"}, "ForlìCesena_x"),
        (X.folder(C("t")), {"t": "/a\\b/"}, "a/b"), (X.folder(C("t")), {"t": "/"}, None), (X.first_segment(C("t")), {"t": "a/b/c"}, "a"), (X.base_name(C("t")), {"t": "a/b/c"}, "c"),
        (X.url_clean(C("t")), {"t": "https://h/a/#x"}, "https://h/a"), (X.url_slug(C("t")), {"t": "https://h/a/b.html/"}, "b"),
        (X.extension(C("t")), {"t": "https://h/a.xlsx?x=.pdf"}, ".xlsx"), (X.extension(C("t")), {"t": "https://h/a.xls/view"}, ".xls"), (X.extension(C("t")), {"t": "https://h/a"}, None),
        (X.month_by_calendar(C("t")), {"t": "/maggio/gennaio/"}, "Gennaio"), (X.month_by_place(C("t")), {"t": "/maggio/gennaio/"}, "Maggio"),
        (X.hierarchy(C("t")), {"t": "https://h/Archivio-2023/marzo"}, ["2023", "Marzo"]), (X.year_of_title(C("t")), {"t": "nessuno"}, "sconosciuto"),
        (X.document_class(C("t")), {"t": "Messaggio n. 3"}, "messaggi"),
        (X.decree_name(C("t")), {"t": "DECRETO LEGISLATIVO 4 dicembre 2025, n. 205"}, "dlgs_04_dicembre_2025_n_205.txt"), (X.decree_name(C("t")), {"t": "Testo unico"}, "dlgs_Testo_unico.txt"),
        (X.author_detail(C("t")), {"t": "di Anna RossieCarlo Bianchi"}, "Anna Rossi e Carlo Bianchi"), (X.author_list(C("t")), {"t": "di Anna e  Carlo"}, "Anna, Carlo"),
        (X.unglue(C("t")), {"t": "conlegge e decretolegge"}, "con legge e decreto legge"), (X.bracketed(C("t")), {"t": "x [un testo abbastanza lungo] y"}, "un testo abbastanza lungo"), (X.bracketed(C("t")), {"t": "[corto]"}, None),
        (X.output_name(C("t")), {"t": "a/b.txt"}, "a/b_output.txt"), (X.strip_citations(C("t")), {"t": "a\ue200cite x\nb"}, "a \nb"), (X.digits(C("t")), {"t": "+39 05-1"}, "39051"),
        (X.title_join(C("a"), C("b")), {"a": "T", "b": ""}, "T"), (X.title_join(C("a"), C("b")), {"a": "T", "b": "S"}, "T. S"),
        (X.file_name(C("a"), C("b")), {"a": "Circolare 1: IVA - pdf", "b": "https://h/x.pdf"}, "Circolare 1_ IVA.pdf"), (X.file_name(C("a"), C("b")), {"a": "", "b": "https://h/un%20file.zip"}, "un file.zip"),
        (X.file_name_notary(C("a"), C("b")), {"a": "Studio – PDF", "b": "https://h/documents/1"}, "Studio.pdf"), (X.file_name_download(C("t")), {"t": "https://h/download.aspx?nomeFile=a%2Fb"}, "a_b.pdf"),
        (X.absolute(C("a"), C("b")), {"a": "../c.pdf", "b": "https://h/a/b/d.html"}, "https://h/a/c.pdf"), (X.absolute(C("a"), C("b")), {"a": "//k/x", "b": "https://h/a"}, "https://k/x"), (X.absolute(C("a"), C("b")), {"a": "c", "b": "https://h"}, "https://h/c"),
        (V.date_slashed(C("t")), {"t": "5-3-2024"}, "05/03/2024"), (V.date_slashed(C("t")), {"t": "2024-03-05"}, "05/03/2024"), (V.date_slashed(C("t")), {"t": "05.03.2024"}, "05/03/2024"), (V.date_slashed(C("t")), {"t": "1/2/2024xx"}, "1/2/2024xx"), (V.date_slashed(C("t")), {"t": "boh"}, "boh"), (V.date_slashed(C("t")), {"t": ""}, ""),
        (V.relevant(C("t")), {"t": '{"relevant": true}'}, True), (V.relevant(C("t")), {"t": '{"relevant": "false"}'}, True), (V.relevant(C("t")), {"t": '{"relevant": false}'}, False), (V.relevant(C("t")), {"t": 'x {"relevant": False} y'}, False), (V.relevant(C("t")), {"t": "it is true"}, True), (V.relevant(C("t")), {"t": "true or false"}, False), (V.relevant(C("t")), {"t": ""}, False),
        (V.retrieve_asked(C("t")), {"t": '{"retrieve": "False"}'}, False), (V.retrieve_asked(C("t")), {"t": "retrieve: false"}, False), (V.retrieve_asked(C("t")), {"t": "?"}, True),
        (V.payload_type(C("t")), {"t": "data:image/png;base64,AA=="}, "image/png"), (V.processor(C("a"), C("b")), {"a": None, "b": "x/y.DOCX"}, "docx"), (V.processor(C("a"), C("b")), {"a": "text/xml", "b": "y"}, "xml"), (V.processor(C("a"), C("b")), {"a": "x/y", "b": "y"}, None),
        (V.content_type(C("a"), C("b"), C("c")), {"a": "", "b": None, "c": "f.csv"}, "text/csv"), (V.decoded_text(C("c")), {"c": "è".encode("latin-1")}, "è"), (V.decoded_text(C("c")), {"c": "è".encode()}, "è"), (V.is_pdf(C("a"), C("c")), {"a": None, "c": b"%PDF-1"}, True),
        (markup.header_value(C("t"), "url"), {"t": "title: x\nurl: 'https://h'\n---"}, "https://h"), (markup.next_page(C("t")), {"t": '<li class="next"><a href="/p/2">2</a></li>'}, "/p/2"),
    ]


def test_scalars(spark):
    wrong = []
    for k, (column, values, want) in enumerate(cases()):
        got = one(spark, column, **values)
        if got != want:
            wrong.append((k, values, got, want))
    assert not wrong


def test_ascii_safe(spark):
    for t in ("àèìòù Ñ ç", "日本 x", "", "é"):
        plain = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").encode("ascii", "replace").decode()
        assert one(spark, X.ascii_safe("t"), t=t) == plain


def test_chunk_ids_are_stable_and_short(spark):
    made = [one(spark, X.chunk_id(C("p"), C("n"), C("o")), p="a/" + "è" * 600, n=1, o=2) for _ in range(2)]
    assert made[0] == made[1] and len(made[0]) == 512


def test_object_name(spark):
    long = "è" * 900 + ".pdf"
    cut = one(spark, X.object_name(C("n"), C("f")), n=long, f="folder")
    assert len(("folder/" + cut).encode()) <= 1024 and cut.endswith(".pdf") and "_____" in cut
    assert one(spark, X.object_name(C("n"), C("f")), n="short", f="") == "short"
    with pytest.raises(Exception, match="Folder path too long"):
        one(spark, X.object_name(C("n"), C("f")), n="x", f="f" * 1020)


def test_attachments(spark):
    got = [one(spark, V.attachment(C("r"), C("i")), r=r, i=0) for r in ("data:text/plain;base64,YQ==", "image/png:AAAA", "YWJj")]
    assert [(g.filename, g.content_type, g.data) for g in got] == [("attachment_1.txt", "text/plain", "data:text/plain;base64,YQ=="), ("attachment_1.png", "image/png", "AAAA"), ("attachment_1", None, "YWJj")]
    assert one(spark, V.payload_bytes(C("d")), d="data:text/plain;base64,YQ==") == b"a"
    with pytest.raises(Exception, match="empty"):
        one(spark, V.attachment(C("r"), C("i")), r=" ", i=0)


def test_cosine(spark):
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert abs(one(spark, V.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(2.0)))) - 1) < 1e-12


PAGE = (
    "<html><head><title>T &amp; U</title><style>x</style></head><body><nav><a href='/n'>Nav</a></nav><article><h1>Head <b>line</b></h1><p>One<p>Two &egrave; <a href=\"/d.pdf\">doc</a></p></article>"
    "<table><tr><td>00100</td><td>Roma</td></tr><tr><td>x</td></tr></table><footer>End</footer><script>no()</script></body></html>"
)


def test_markup(spark):
    assert one(spark, markup.main_text("h"), h=PAGE).split("\n") == ["T & U", "Head line", "One", "Two è doc", "00100", "Roma", "x"]
    assert one(spark, markup.paragraphs("h"), h=PAGE) == ["One", "Two è doc"]
    assert [(x.href, x.text) for x in one(spark, markup.links("h"), h=PAGE)] == [("/n", "Nav"), ("/d.pdf", "doc")]
    assert [(x.cap_code, x.comune) for x in one(spark, markup.table_pairs("h"), h=PAGE)] == [("00100", "Roma")]
    assert one(spark, markup.title(C("h")), h=PAGE) == "Head line"
    assert one(spark, markup.hrefs(C("h")), h=PAGE) == ["/n", "/d.pdf"]
    assert one(spark, markup.xml_text("h", F.lit(50)), h="<a>x<b>y</b>z</a>") == "x\ny\nz"
    assert one(spark, markup.xml_text("h", F.lit(50)), h="<a>") is None
    law = '<l xmlns="u:x"><article><num>Art. 1</num><p>Text  one</p></article><article id="2"><p>two</p></article></l>'
    assert [(a.num, a.text) for a in one(spark, markup.law_articles("h"), h=law)] == [("Art. 1", "Art. 1Text one"), ("2", "two")]


def test_extraction(spark):
    rows = [("a.txt", b"hello", "text"), ("b.xml", b"<a>x</a>", "xml"), ("c.pdf", b"%PDF", "pdf"), ("d.bin", b"", None), ("e.txt", b" ", "text")]
    out = {r.storage_path: (r.text, r.status, r.message) for r in adapters.extracted(spark.createDataFrame(rows, "storage_path string, content binary, processor string")).collect()}
    assert out["a.txt"] == ("hello", "success", "") and out["b.xml"] == ("x", "success", "")
    assert out["c.pdf"][1:] == ("skipped", "format not supported: pdf") and out["d.bin"][1:] == ("error", "No document processor available") and out["e.txt"][1:] == ("error", "No chunks generated")
    pages = spark.createDataFrame([("a", i, "t") for i in range(1, 4)] + [("b", i, "") for i in range(1, 30)] + [("c", i, "t") for i in range(1, 402)], "f string, page int, text string")
    read = {r.f: r.n for r in adapters.pages_to_read(pages, "f").groupBy("f").agg(F.count("*").alias("n")).collect()}
    assert read == {"a": 3, "b": 15}
    assert one(spark, adapters.page_text(C("t"), F.array(F.lit("img"))), t="bad (CID:1)") == "img"
    images = spark.createDataFrame([("f", 1, b"x"), ("f", 2, b"x"), ("f", 2, b"y"), ("g", 1, b"x")], "f string, page int, content binary")
    assert sorted((r.f, r.page) for r in adapters.unique_images(images, "f", "page").collect()) == [("f", 1), ("f", 2), ("g", 1)]
    assert one(spark, adapters.chain(F.upper, adapters.echo)(C("t")), t="a") == one(spark, adapters.echo(C("t")), t="A")


def test_law_pages(spark):
    page = '<div class="bodyTesto x"><h2 class="article-num-akn">Art. 3</h2><div class="art-comma-div-akn"><span class="comma-num-akn">1.</span><span class="art_text_in_comma">Primo <b>comma</b>.</span></div><div class="art-comma-div-akn">Senza numero</div></div>'
    got = one(spark, markup.law_article("h"), h=page)
    assert (got.num, got.text) == ("Art. 3", "1. Primocomma.\nSenza numero")
    bare = one(spark, markup.law_article("h"), h='<div class="bodyTesto"><p>uno<br>due</p></div>')
    assert (bare.num, bare.text) == ("Articolo", "uno\ndue")
    assert one(spark, markup.law_article("h"), h="<p>x</p>").num is None
    xml = "<doc>out<section>a<p>b</p>c</section></doc>"
    assert one(spark, markup.xml_sections("h"), h=xml) == "b\n\na c"
    assert one(spark, markup.xml_sections("h"), h="<doc>x<y>z</y></doc>") == "x\nz" and one(spark, markup.xml_sections("h"), h="<d") is None
    assert one(spark, markup.loader_paths(C("h")), h="showArticle('/atto/caricaArticolo?a=1','x') showArticle('/atto/caricaArticolo?a=2')") == ["/atto/caricaArticolo?a=1", "/atto/caricaArticolo?a=2"]
