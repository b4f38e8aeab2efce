"""Parsers of single files, on small inputs made by hand."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from orrery.plans.ingestion import _docx, _pdf
from orrery.sources import encodings, files, markdown, office, pdf, symbols


@pytest.mark.parametrize(
    "encoding, text",
    [
        ("cp1252", "El niño ¿qué tal? Größe, déjà vu – it’s “fine”"), ("cp1250", "Zażółć gęślą jaźń, příliš žluťoučký kůň"), ("cp1251", "Съешь ещё этих мягких французских булок"), ("koi8-r", "Съешь ещё этих мягких французских булок"),
        ("iso8859-7", "Ελληνικά γράμματα και λέξεις"), ("utf-8", "naïve 東京 🙂"), ("utf-8-sig", "naïve"), ("utf-16", "mark"), ("utf-16-le", "no mark, mostly Latin é"), ("utf-16-be", "no mark, mostly Latin é"), ("utf-32-le", "wide"), ("utf-32-be", "wide"), ("utf-8", ""), ("utf-8", "plain"),
    ],
)
def test_encodings_are_told_from_bytes(encoding, text):
    assert encodings.decoded(text.encode(encoding)) == (text, encoding)


def test_any_bytes_are_read():
    rng = random.Random(2)
    for n in (1, 3, 50, 5000):
        text, _ = encodings.decoded(rng.randbytes(n))
        assert isinstance(text, str)


def found(language, source):
    return [(s["symbol_name"], s["symbol_type"], s["start_line"], s["end_line"]) for s in symbols.symbols_of(source, language)]


def test_symbols_of_javascript():
    source = r"""// class No {}
/* function no() { */
const s = "class { {", t = `a ${ {a: "}"}.a + `in}ner` } function no() {`, re = /[{]\/}/g
export default class A extends B {
  x = 1
  #p = () => { return 1 }
  static async *gen(a = {}) { if (a) { while (1) { } } }
  get v() { return { m() { return 1 }, k: function () {} } }
  constructor() { super() }
}
function* g() { yield 1 }
async function f(a) {
  function inner() {}
  const cls = class { meth() {} }
  foo(function named() { class Deep {} })
}
const half = a / 2, o = { m2() {} }
"""
    assert found("javascript", source) == [
        ("A", "class", 4, 10), ("gen", "method", 7, 7), ("v", "method", 8, 8), ("m", "method", 8, 8), ("constructor", "method", 9, 9), ("g", "function", 11, 11), ("f", "function", 12, 16), ("inner", "function", 13, 13),
        ("meth", "method", 14, 14), ("Deep", "class", 15, 15), ("m2", "method", 17, 17),
    ]


def test_symbols_of_typescript():
    source = """export abstract class Q<T> implements I {
  private readonly a: { b: number } = { b: 1 };
  abstract m(): void;
  public static run<T>(x: T): Promise<{a: T}> { return x as any }
  constructor(private x: number) { super(); }
}
interface I { f(): void; g: { h(): void } }
function over(a: string): void;
function over(a: any) { }
type X = { a: string }
"""
    assert found("typescript", source) == [("Q", "class", 1, 6), ("run", "method", 4, 4), ("constructor", "method", 5, 5), ("I", "class", 7, 7), ("over", "function", 9, 9)]


def test_symbols_of_go():
    source = """package main
// func no() {
type A struct {
	x int `json:"}"`
	f func(a int) struct{ y int }
}
type (
	B int
	C interface { M() }
)
type D = map[string]struct{}
func (a *A) Method(x int) (int, error) {
	type local struct { z int }
	g := func() { fmt.Println("{") }
	if x := 1; x > 0 { g() } else { }
}
func Gen[T any](x T) T { return x }
var r = '{'
"""
    assert found("go", source) == [(None, "class", 3, 6), (None, "class", 7, 10), (None, "class", 11, 11), ("Method", "method", 12, 16), (None, "class", 13, 13), ("Gen", "function", 17, 17)]


def test_symbols_of_rust():
    source = """#[derive(Debug)]
pub struct P<'a> { x: &'a str }
struct Unit;
/* a /* nested { */ } */
pub(crate) enum E { A { x: i32 }, B }
trait Tr { fn sig(&self) -> i32; fn def(&self) -> i32 { 1 } }
impl<'a> Tr for P<'a> { fn sig(&self) -> i32 { let r = r#"}"}"#; match c { '{' => 1, _ => { 2 } } } }
pub async unsafe fn run<F: Fn(i32) -> i32>(f: F) where F: Send { let p = P { x: "a" }; if true { fn nested() {} } }
mod m { pub fn inner() {} }
"""
    assert found("rust", source) == [
        ("P", "class", 2, 2), ("Unit", "class", 3, 3), ("E", "class", 5, 5), ("Tr", "class", 6, 6), ("def", "function", 6, 6), (None, "class", 7, 7), ("sig", "function", 7, 7), ("run", "function", 8, 8), ("nested", "function", 8, 8), ("inner", "function", 9, 9),
    ]


def test_symbols_of_java():
    source = '''@Foo(x = "{")
public class A<T> extends B implements C {
  private int x = foo();
  int[] a = { 1, 2 };
  static { init(); }
  Runnable r = new Runnable() { @Override public void run() { } };
  public A(int x) { this.x = x; }
  @Override @Bar(1) public <K> Map<K, List<T>> get(K k) throws E { return new HashMap<>() {{ put(1, 2); }}; }
  abstract void abs();
  enum En { X(1), Y(2) { int v() { return 1; } }; En(int i) { } int w() { return 0; } }
  interface In { void m(); default int d() { return 1; } }
  String s = """
    class { "quoted" } """;
  void last() { if (x) { foo(); } switch (x) { case 1 -> { } } Object o = B.class; }
}
'''
    assert found("java", source) == [
        ("A", "class", 1, 15), ("run", "method", 6, 6), ("A", "method", 7, 7), ("get", "method", 8, 8), ("abs", "method", 9, 9), ("v", "method", 10, 10), ("En", "method", 10, 10), ("w", "method", 10, 10), ("In", "class", 11, 11),
        ("m", "method", 11, 11), ("d", "method", 11, 11), ("last", "method", 14, 14),
    ]


def test_broken_sources_end():
    rng = random.Random(4)
    some = ["class A", "{", "}", "(", ")", "fn x", "func f()", "`", '"', "/*", "*/", "'", ";", "\n", "type T", "=>", "@", "new", "interface I", "impl", "<", ">", "enum E", "${"]
    for language in ("python", "javascript", "typescript", "tsx", "go", "rust", "java"):
        for _ in range(300):
            text = " ".join(rng.choice(some) for _ in range(rng.randint(0, 30)))
            for s in symbols.symbols_of(text, language):
                assert 1 <= s["start_line"] <= s["end_line"]


@pytest.mark.parametrize(
    "marked, plain",
    [
        ("*em* **strong** ***both*** _a_b_ __x__ a*b*c 2 * 3 * 4 ~~gone~~ snake_case_name", "em strong both a_b x abc 2 * 3 * 4 gone snake_case_name"),
        ("`code *x*` ``a ` b`` [link *t*](http://x.y/(z) \"t\") ![alt](i.png) <http://a.b> &amp; \\*esc\\*", "code *x* a ` b link t alt http://a.b & *esc*"),
        ("**bold*", "*bold"), ("[a [nested] b](u) [ref][r] [r] [no] <b>x</b>", "a [nested] b ref r [no] <b>x</b>"), ("a  \nb\\\nc", "a\nb\nc"), ("``` open", "``` open"),
    ],
)
def test_inline_marks_are_taken_away(marked, plain):
    assert markdown.plain(marked, frozenset({"r"})) == plain


def test_markdown_sections_are_plain_text():
    text = """intro *x*

# Title `c` #

text **b**
more

### Deep
- one
- two
  cont
  - nested *n*

    para

3. three

> quote **q**
> - inner
lazy

~~~py
# no heading
~~~

    code

| a | b |
|---|:-:|
| 1 | `x\\|y` |

***

Other
-----
last [r]

[r]: http://x
"""
    got = [(s["heading_path"], s["heading_level"], s["text"]) for s in markdown.sections_of(text)]
    assert got == [
        (None, None, "intro x"),
        ("Title c", 1, "Title c\n\ntext b\nmore"),
        ("Title c > Deep", 3, "Deep\n\none\ntwo\ncont\nnested n\npara\nthree\n\nquote q\ninner\nlazy\n\n# no heading\n\ncode\n\na | b\n1 | x|y"),
        ("Title c > Other", 2, "Other\n\nlast r"),
    ]


def test_markdown_of_any_text_ends():
    rng = random.Random(6)
    some = ["#", "-", ">", "```", "    ", "\n", "\n\n", "*", "_", "[", "](", ")", "`", "|", "---", "1.", "x", "<div>", "~~~", "\t", "[a]: b", "==="]
    for _ in range(1500):
        list(markdown.sections_of("".join(rng.choice(some) for _ in range(rng.randint(0, 40)))))


def test_text_documents():
    data = _docx("Top", [("First", "a & <b>\nline", "web"), ("Second", "", "x")])
    assert [(s["heading_path"], s["heading_level"], s["text"]) for s in office.sections_of(data)] == [("Top > First", 2, "Top\nFirst\na & <b>\nline\nsource | web"), ("Top > Second", 2, "Top\nSecond\nsource | x")]
    styles = '<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:style w:styleId="h"><w:name w:val="heading 1"/></w:style><w:style w:styleId="own"><w:name w:val="Mine"/><w:basedOn w:val="h"/></w:style></w:styles>'
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>before</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="own"/></w:pPr><w:r><w:t>One</w:t></w:r></w:p><w:p><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:r><w:t>Two</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/styles.xml", styles)
        archive.writestr("word/document.xml", body)
    assert [(s["heading_path"], s["text"]) for s in office.sections_of(out.getvalue())] == [(None, "before"), ("One", "One"), ("Two\tb", "Two\tb")]


def test_presentations():
    space = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def shape(text, holder=""):
        return f'<p:sp><p:nvSpPr><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("ppt/presentation.xml", f'<p:presentation {space}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/><p:sldId r:id="r3"/></p:sldIdLst></p:presentation>')
        archive.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{rels}">' + "".join(f'<Relationship Id="r{i}" Type="{kind}/slide" Target="slides/slide{i}.xml"/>' for i in (1, 2, 3)) + "</Relationships>")
        archive.writestr("ppt/slides/slide1.xml", f'<p:sld {space}>{shape("only text")}{shape("7", "<p:ph type=" + chr(34) + "sldNum" + chr(34) + "/>")}</p:sld>')
        archive.writestr("ppt/slides/slide2.xml", f'<p:sld {space}>{shape("body")}{shape("Head", "<p:ph type=" + chr(34) + "title" + chr(34) + "/>")}</p:sld>')
        archive.writestr("ppt/slides/slide3.xml", f"<p:sld {space}></p:sld>")
        archive.writestr("ppt/slides/_rels/slide2.xml.rels", f'<Relationships xmlns="{rels}"><Relationship Id="n" Type="{kind}/notesSlide" Target="../notesSlides/n.xml"/></Relationships>')
        archive.writestr("ppt/notesSlides/n.xml", f'<p:notes {space}>{shape("said", "<p:ph type=" + chr(34) + "body" + chr(34) + "/>")}</p:notes>')
    got = [(s["page_number"], s["total_pages"], s["heading_path"], s["text"]) for s in office.sections_of(out.getvalue())]
    assert got == [(1, 3, "Head", "Head\nbody\nsaid"), (2, 3, None, "only text")]
    with pytest.raises(ValueError):
        list(office.sections_of(_docx("x", []).replace(b"word/document.xml", b"word/dokument.xml")))


def test_pdf_pages_and_numbers():
    got = [(s["page_number"], s["total_pages"], s["text"]) for s in pdf.sections_of(_pdf(["Héllo (world) \\ é\nsecond", "", "third"]))]
    assert got == [(1, 3, "Héllo (world) \\ é\nsecond"), (3, 3, "third")]
    for bad in (b"no pdf", b"%PDF-1.4\ntrailer << /Encrypt 1 0 R /Root 2 0 R >>"):
        with pytest.raises(ValueError):
            list(pdf.sections_of(bad))


def test_pdf_codes_of_one_byte_go_through_a_table_made_once(monkeypatch):
    asked = []
    shown = pdf.Font.shown
    monkeypatch.setattr(pdf.Font, "shown", lambda self, code: asked.append(code) or shown(self, code), raising=False)
    texts = [f"page {i} " + "Wörter " * 500 for i in range(20)]
    assert [s["text"] for s in pdf.sections_of(_pdf(texts))] == [t.strip() for t in texts]
    assert len(asked) == 256  # for all pages, not for each of their 70,000 bytes


def test_pdf_maps_codes_and_gaps():
    cmap = b"1 begincodespacerange <00> <FFFF> endcodespacerange 1 beginbfchar <0003> <00DC> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    content = b"BT /F 10 Tf [<0003> -50 <0010> -300 <00110012>] TJ 0 -12 Td (\\000\\020) Tj ET"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents [4 0 R] /Resources << /Font << /F 5 0 R >> >> >>"]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (i, o) for i, o in enumerate(objects, 1))
    data += b"4 0 obj << /Length %d >> stream\n%s\nendstream endobj\n5 0 obj << /Subtype /Type0 /ToUnicode 6 0 R >> endobj\n6 0 obj << /Length 9999 >> stream\n%s\nendstream endobj\ntrailer << /Root 1 0 R >>" % (len(content), content, cmap)
    assert [s["text"] for s in pdf.sections_of(data)] == ["Üa bc\na"]


def test_paragraphs_are_packed_and_long_ones_cut():
    text = "a b\n\n\n\nc d e\n\n" + " ".join(f"w{i}" for i in range(12)) + "\n\nz"
    got = [s["text"] for s in files._paragraphs(text, 5, 1)]
    assert got == ["a b\n\nc d e", "w0 w1 w2 w3 w4", "w4 w5 w6 w7 w8", "w8 w9 w10 w11", "z"]


def test_files_get_their_ending_without_being_renamed(spark, tmp_path):
    """A rename by the driver for each file took longer than the rest; the files stay as Spark wrote them."""
    from orrery.plans import ingestion

    rows = spark.createDataFrame([(i, f'[{{"a": {i}}}]') for i in range(5)], "file_id long, content string")
    ingestion._write_texts(rows, str(tmp_path / "json"))
    assert len(list((tmp_path / "json").rglob("part-*.txt"))) == 5
    found = ingestion._found(spark, str(tmp_path / "json"), F.lit(".json"))
    assert found.where("path LIKE '%.json' AND filename LIKE '%.json'").count() == 5
    got = files.parse_files(found).select(ingestion._file_id(F.col("path")).alias("i"), "text", "parser").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(i, f"a={i}", "json") for i in range(5)]
