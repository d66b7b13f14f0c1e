from kbforge.functions import helpers as h
from kbforge.functions.stemming import stem
from kbforge.operators import retrieval


def test_chunkers():
    assert h.chunk_plain("") == [] and h.chunk_plain("a\n\nb") == ["a\n\nb"]
    parts = h.chunk_plain("\n\n".join(f"Paragraph {i}. " + "x" * 400 for i in range(6)), 1000, 0)
    assert len(parts) == 3 and "".join(parts).count("Paragraph") == 6
    code = "# T\n\nintro\n\n## S\n\n" + "word " * 900 + "\n\n```python\nprint(1)\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n" + "tail " * 50
    got = h.chunk_semantic(code)
    assert ("```python\nprint(1)\n```", "S", "code") in got and any(k == "table" and t.startswith("| a") for t, _, k in got)
    assert h.chunk_semantic("short") == [("short", None, "complete")] and h.chunk_semantic("  ") == []
    case = h.chunk_support_case("before\n## A\none\n## B\ntwo\n## A\nthree\n## C\n", whole=0)
    assert case == [("## A\nthree", "A", "section"), ("## B\ntwo", "B", "section")]
    assert h.chunk_support_case("## A\none\n## B\ntwo\n## A\n\n", whole=0) == [("## A\none", "A", "section"), ("## B\ntwo", "B", "section")]
    assert h.chunk_support_case("## A\none") == [("## A\none", None, "complete")] and h.chunk_support_case(None) == []


def test_overlaps():
    assert h.tail_of("short", 20) == "short" and h.tail_of("x" * 30, 20) == "x" * 20
    # The last sentence's end counts, and only past the middle of the overlap.
    assert h.tail_of("This is a sentence. Another sentence here. And a last one", 40) == "And a last one"
    assert h.tail_of("aaaa. bb. cccccccccccccccccc", 20) == "b. cccccccccccccccccc"[1:]
    words = lambda t: len(t.split())
    text = "First sentence. Second sentence. Third sentence here."
    assert h.sentences_tail(text, 10, words) == text
    assert h.sentences_tail(text, 3, words) == "Third sentence here."
    assert h.sentences_tail(text, 4, words) == "Second sentence. Third sentence here."
    assert h.sentences_tail("one two three four five six. a b c d e f g", 3, words) == "a b c d e f g."
    assert h.sentences_tail("no end at all but many words in it", 2, words) == "ords in it"


def test_paragraphs():
    words = lambda t: len(t.split())
    text = "A one. A two three.\n\nB one two three.\n\n\n\nC one two."
    assert h.chunk_paragraphs(text, 8, 3, 2, words) == ["A one. A two three.", "A two three.\n\nB one two three.", "B one two three.\n\nC one two."]
    assert h.chunk_paragraphs(text, 100, 3, 2, words) == ["A one. A two three.\n\nB one two three.\n\nC one two."]
    assert h.chunk_paragraphs(text, 2, 3, 100, words) == [text] and h.chunk_paragraphs(" \n") == []


def test_quotes_and_signatures():
    mail = "Hi\n> a\n\n> b\nOn 1/2/2025 X wrote:\nold\n\nnew\nMany thanks,\nme\n\nLe 3 mars, Y a écrit :\nvieux\n\nafter\n-----Original Message-----\ngone\n\n=====\ngone too\n\nlast\nSent from my iPhone\nx\n--- Message 2 ---\nCheers\n"
    assert h.clean_thread_quotes(mail) == "Hi\nnew\nafter\nlast\n--- Message 2 ---"
    assert h.clean_thread_quotes("text\nCheers,\nme", signatures=False) == "text\nCheers,\nme"


def test_senders():
    own = "acme.example"
    assert h.sender_of('"Ann via Help" <help@acme.example>', "ann@x.org", "", own) == ("Ann", "ann@x.org", True)
    assert h.sender_of("Team <t@acme.example>", "", "Bob <bob@x.org>", own) == ("Bob", "bob@x.org", True)
    assert h.sender_of("Bob Via Group <g@y.org>", "", "help@acme.example", own) == ("Bob", "g@y.org", False)
    assert h.sender_of("plain@x.org", "", "", own) == ("", "plain@x.org", False)


def test_stems():
    # Examples from the published description of the algorithm.
    words = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
    hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit
    conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
    callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
    revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
    adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()
    for word, want in zip(words[::2], words[1::2]):
        assert stem(word) == want, word
    assert stem("straße") == "straße" and stem("is") == "is"


def test_placeholders_are_shared_in_a_thread():
    got = h.anonymize(["cy-rcp-12-3 and a@b.com, +41 79 123 45 67", "A@B.com CY-RCP-12-3 x@own.org 8080 1.2.3"], "own.org")
    assert got[0].startswith("[SERIAL:RCP-1] and [EMAIL-1], [PHONE-1]") and got[1] == "[EMAIL-1] [SERIAL:RCP-1] x@own.org 8080 1.2.3"


def test_pages_and_mail():
    page = "<html><head><title>A | Site</title></head><body><nav>no</nav><div class='menu'>no</div><main><p>yes</p><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table><script>no</script></main></body>"
    assert h.html_page(page) == ("yes | a | b\\|c |\n| --- | --- |\n| 1 |  |", "A") and h.html_page(None) == ("", "Untitled")
    mail = "Hello\n> old\nOn Monday X wrote:\nquoted\n\nback\n--\nme\n---\nnext"
    assert h.clean_thread_quotes(mail) == "Hello\nback\n---\nnext"
    assert h.apply_fixes("Foo foo", [("FOO", "bar"), ("zz", "y")]) == ("bar foo", 1)


def test_diversity(spark):
    rows = [(1, i, "docs", 1.0 - i / 100) for i in range(6)] + [(1, 10, "cases", 0.6), (1, 11, "custom", 0.55), (2, 1, "docs", 0.9), (2, 2, "cases", 0.1)]
    got = retrieval.merge_sources_diverse(spark.createDataFrame(rows, "query_id long, doc_id long, source string, score double"), 4).collect()
    assert [r.doc_id for r in sorted(got) if r.query_id == 1] == [0, 1, 2, 11] and len(got) == 6


def test_context_budget(spark):
    rows = [(1, r, 0.5, "docs", f"g{r % 3}", "x" * 3000 + "</document>") for r in range(1, 9)]
    text = retrieval.build_context(spark.createDataFrame(rows, "query_id long, rank int, score double, source string, group_key string, text string")).first().context
    # The third wrapped group passes the budget and is cut, so its closing mark is gone.
    assert text.count("<document ") == 3 and text.count("</document>") == 2 and len(text) == 12000 + len("...") + 2 and text.endswith("x...")
