import pytest

from docweave.operators import knowledge as K
from docweave.operators import quantity as Q
from docweave.operators.html_tree import Node, node_rows, parse_html, parse_xml, serialize
from docweave.operators.linearize import DEFAULT_RULES, EMPTY_RULES, Flat, Piece, Rules
from docweave.operators.patterns import any_tag, empty_seq, label_tree, matches, maybe, seq, sequences, tag
from docweave.operators.tokenize import is_display, is_reference, split_sentences, split_words

SUM = "<math><semantics><mrow><mn>2</mn><mo>+</mo><mi>k</mi></mrow><annotation-xml><apply><plus/><cn>2</cn><ci>k</ci></apply></annotation-xml></semantics></math>"


def _marked(markup, rules, edits):
    f = Flat(parse_xml(markup), rules)
    for k, (pos, after) in enumerate(edits):
        f.add(Node(f"n{k}"), pos, after)
    f.apply()
    return f, serialize(f.root)


def test_insertion_in_text_and_tail():
    f, out = _marked("<list>one<item>two</item>three<br/>four</list>", EMPTY_RULES, [(1, False), (4, True), (9, False), (13, True)])
    assert f.string == "onetwothreefour"
    assert out == "<list>o<n0/>ne<item>tw<n1/>o</item>thr<n2/>ee<br/>fou<n3/>r</list>"
    f.add(Node("late"), 0)
    with pytest.raises(ValueError):
        f.apply()
    f.apply(force=True)


def test_insertion_beside_a_stand_in():
    rules = Rules(replace_tags={"fig": "PIC"})
    # the character inside of a stand-in doesn't matter, only the side
    f, out = _marked("<doc>see <fig>pixels</fig> here</doc>", rules, [(5, False), (4, True), (6, True), (8, False)])
    assert f.string == "see PIC here" and f.node(3).tag == "doc" and f.node(5).tag == "fig"
    assert out == "<doc>see <n0/><fig>pixels</fig><n1/><n2/> <n3/>here</doc>"


def test_order_of_insertions_at_one_gap():
    _, out = _marked("<v>uw</v>", EMPTY_RULES, [(1, False), (0, True), (1, False), (0, True), (0, False)])
    assert out == "<v><n4/>u<n3/><n1/><n0/><n2/>w</v>"


def test_every_single_insertion_keeps_the_text():
    markup = "<r>ab<s>cd<t/>e</s>f<u>g</u><w>h</w></r>"
    for pos in range(8):
        for after in (False, True):
            f, out = _marked(markup, EMPTY_RULES, [(pos, after)])
            assert Flat(parse_xml(out), EMPTY_RULES).string == f.string
            head = out[: out.index("<n0/>")]
            assert Flat(parse_html(head), EMPTY_RULES).string == f.string[: pos + after]


def test_highlight():
    f = Flat(parse_xml("<p>in the year 1999 it</p>"), EMPTY_RULES)
    f.highlight(12, 15, "green", 1.5, "note")
    f.apply()
    assert serialize(f.root) == '<p>in the year <span style="color:green; font-size:150.0%">[</span>1999<span style="color:green; font-size:150.0%">]</span><sup style="color:blue">note</sup> it</p>'


def test_skipping_wins_and_tails_stay():
    rules = Rules(skip_classes=frozenset({"gone"}), replace_tags={"q": "Q"}, replace_classes={"c": "C"})
    assert Flat(parse_xml('<a><q class="gone">1</q>t<q>2<q>3</q></q>u<!-- c -->v<b class="x c">w</b></a>'), rules).string == "tQuvC"


def test_addresses_round_trip():
    f = Flat(parse_html("<div>ab<i>c</i>d</div><div>e<math>x</math>f</div>"), DEFAULT_RULES)
    for k in range(len(f.string)):
        start, end = f.position(f.point(k))
        assert (start, end) == (k, None) if f.token(k).kind != "node" else start <= k < end
    assert f.position("/html") == (0, len(f.string))
    assert f.span(0, 2) == "/html/body/div[1]+text0&/html/body/div[1]/i+text0&False"
    assert f.span(1, 99).endswith("&/html/body/div[2]/math+tail0&True")
    assert f.token(5).node.tag == "math" and f.token(5).surrounding.tag == "math"


def test_paths_in_one_pass():
    root = parse_html("<ul>" + "<li>x<b>y</b></li>" * 300 + "</ul><!-- c --><p>z")
    paths = root.paths()
    assert len(set(paths.values())) == len(paths)
    for n in root.walk():
        assert root.find(paths[id(n)]) is n and n.path() == paths[id(n)]
    assert [r[9] for r in node_rows(root)] == [paths[id(n)] for n in root.walk()]
    wide = parse_html("<ul>" + "<li>x</li>" * 100_000 + "</ul>")
    assert wide.paths()[id(wide.children[0].children[0].children[-1])] == "/html/body/ul/li[100000]"


def test_recovery():
    out = serialize(parse_html('<title>a</title><ol><li>x<li>y</ol><p>one<p>two <em>bold<hr>z<script>let t="</p>";</script>&copy;'))
    assert out == '<html><head><title>a</title></head><body><ol><li>x</li><li>y</li></ol><p>one</p><p>two <em>bold</em></p><hr/>z<script>let t="</p>";</script>©</body></html>'
    assert serialize(parse_html(None)) == "<html/>"


def test_references():
    def text(markup, *more):
        return Flat(parse_html(markup, *more), EMPTY_RULES).string

    assert text("<p>&amp;lt; &amp</p><p>&#38 &#x26; &notit; &nosuch; &</p>") == "&lt; &amp& & &notit; &nosuch; &"
    root = parse_html('<a&b href="?x=1&lt=2&amp;y"><!--&amp;--><script>a&amp;b</script>﷐</a&b>')
    assert serialize(root) == '<html><body><a&b href="?x=1&amp;lt=2&amp;y"><!--&amp;--><script>a&amp;b</script>﷐</a&b></body></html>'
    assert text("<p>&amp;&quot;&#38;</p>", frozenset({"amp"})) == "&&quot;&#38;"


def test_patterns():
    m = parse_xml(SUM)
    inside = tag("math") / tag("semantics")
    (found,) = matches(inside / tag("mrow") / seq(tag("mn") ** "left", tag("mo") ** "sign", tag("mi") ** "right"), m)
    t = label_tree(found)
    assert t.label == "root" and [c.label for c in t.children] == ["left", "sign", "right"] and t["right"].node.text == "k" and "sign" in t and "none" not in t
    with pytest.raises(KeyError):
        t["none"]
    either = inside / (tag("mrow") / (tag("mn") | tag("mi")) ** "leaf" | tag("annotation-xml") / tag("apply") / (tag("cn") | tag("ci")) ** "leaf")
    assert [label_tree(x)[0].node.tag if label_tree(x).label == "root" else label_tree(x).node.tag for x in matches(either, m)] == ["mn", "mi", "cn", "ci"]
    assert len(list(sequences(seq() | empty_seq, [m], 0))) == len(list(sequences(maybe(any_tag), [m], 0))) == 2
    assert list(matches(tag("math").with_text("k"), m)) == [] and list(matches(any_tag.with_class("y"), parse_xml('<a class="x"/>'))) == []
    assert len(list(matches(any_tag.with_class("z", "x"), parse_xml('<a class="w x"/>')))) == 1
    with pytest.raises(ValueError):
        list(matches((tag("math") / any_tag) ** "x" / any_tag, m))
    with pytest.raises(TypeError):
        tag("a") | seq(tag("b"))


def _quantities(inner):
    return list(matches(Q.QUANTITIES, parse_xml(f"<math><semantics>{inner}</semantics></math>")))


def _reading(inner):
    (found,) = _quantities(inner)
    t = label_tree(found)
    return Q.read_scalar(Q._first(t, "scalar")), [(n[1].get("val", n[0]), e) for n, e in Q.unit_parts(Q._first(t, "unit"))]


def test_quantities():
    assert _reading("<mrow><mn>70</mn><mtext>  </mtext><mi>km</mi></mrow>") == (Q.Scalar(70.0, Q.IS_INT), [("km", 1)])
    assert _reading("<mrow><mi>v</mi><mo>≲</mo><mrow><mrow><mo>–</mo><mn>4.5</mn></mrow><mrow><mi>m</mi><msup><mi>s</mi><mrow><mo>-</mo><mn>1</mn></mrow></msup></mrow></mrow></mrow>") == (Q.Scalar(-4.5, 0), [("m", 1), ("s", -1)])
    assert _quantities("<mrow><mi>v</mi><mo>+</mo><mrow><mn>4</mn><mi>m</mi></mrow></mrow>") == []
    assert Q.read_numeral("1 000") == 1000 and Q.read_numeral("0.250") == 0.25
    for bad in ("3.1.4", "none"):
        with pytest.raises(Q.Unreadable):
            Q.read_numeral(bad)


def test_powers_of_ten():
    power = "<msup><mn>10</mn><mrow><mo>-</mo><mn>6</mn></mrow></msup>"
    scalar, _ = _reading(f"<mrow><mrow><mn>7</mn><mtext>×</mtext>{power}</mrow><mi>g</mi></mrow>")
    assert scalar.value == pytest.approx(7e-6) and scalar.flags == Q.SCIENTIFIC
    assert _reading("<mrow><msup><mn>10</mn><mn>3</mn></msup><mi>g</mi></mrow>")[0] == Q.Scalar(1000.0, Q.IS_INT)
    # a factor left empty, and only the sign itself counts
    scaled = "<mrow><mrow><mi/><mo>{}</mo><msup><mn>10</mn><mn>3</mn></msup></mrow><mi>g</mi></mrow>"
    assert _reading(scaled.format(Q.INVISIBLE_TIMES))[0].value == 1000.0
    assert _quantities(scaled.format(Q.INVISIBLE_TIMES + "x")) == []


def test_units_out_of_range_and_scripts():
    unit = Q.GRAMMARS["all"]["Unit"]
    t = label_tree(next(matches(unit, parse_xml("<msup><mi>m</mi><mn>10</mn></msup>"))))
    with pytest.raises(Q.Unreadable):
        Q.unit_parts(t)
    t = label_tree(next(matches(unit, parse_xml('<msub><mi>M</mi><mrow><mo>⊙</mo><mi mathvariant="normal">e</mi></mrow></msub>'))))
    assert K.unit_json(Q.unit_parts(t)) == '[[["sub", {}, [["i", {"isitalic": true, "val": "M"}, []], ["seq", {}, [["i", {"val": "\\u2299"}, []], ["i", {"val": "e"}, []]]]]], 1]]'
    with pytest.raises(Q.Unreadable):
        Q.symbol_notation(parse_xml("<mfrac><mi>a</mi><mi>b</mi></mfrac>"))
    named = Q.GRAMMARS["all"]["Named"]
    assert [len(list(matches(named, parse_xml(x)))) for x in ("<mi>a</mi>", "<msup><mo>+</mo><mn>2</mn></msup>", "<msubsup><mi>a</mi><mn>1</mn><mn>2</mn></msubsup>", "<msub><mn>1</mn><mn>2</mn></msub>", "<mn>1</mn>")] == [1, 1, 1, 0, 0]


def test_units_and_dimensions():
    assert K.unit_json(K.parse_unit("km/h")) == '[[["i", {"val": "km"}, []], 1], [["i", {"val": "h"}, []], -1]]'
    names = lambda s: [(n[1]["val"], e) for n, e in K.parse_unit(s)]
    assert names("W/(m² K)") == [("W", 1), ("m", -2), ("K", -1)] and names("kg m² s⁻³") == [("kg", 1), ("m", 2), ("s", -3)]
    assert names("mol (air)") == [("mol(air)", 1)] and names("a)b") == [("ab", 1)] and names("") == []
    with pytest.raises(ValueError):
        K.parse_unit("m⁻")
    assert K.dimension_key({"M": 1, "L": 2, "T": -3}) == "T⁻³L²M¹" and K.dimension_key({"L": 0}) == "1"
    with pytest.raises(ValueError):
        K.dimension_key({"X": 1})
    n = K.notation("sup", {"z": 1, "a": "ü"}, [K.notation("i", {"val": "ä"}), K.notation("seq", {}, [K.notation("i")])])
    assert K.notation_from_json(K.notation_json(n)) == n and sorted([K.notation_json(n), "["]) == ["[", K.notation_json(n)]
    with pytest.raises(ValueError):
        K.notation("sub", {}, [n])
    style = lambda inner: K.dimension_from_mathml(f"<math xmlns='u'><mstyle>{inner}</mstyle></math>")
    assert style("<mi>M</mi><mrow><mi>L</mi></mrow><msup><mi>T</mi><mrow><mo>-</mo><mn>3</mn></mrow></msup>") == "T⁻³L¹M¹" and style("<mn>1</mn>") == "1"
    for bad in ("<mi>T</mi><mi>T</mi>", "<mn>2</mn>", "<mo>·</mo>"):
        with pytest.raises(ValueError):
            style(bad)
    rows = [("r", None, ["s"]), ("s", "T¹", []), ("x", None, ["y"]), ("y", None, ["x"]), ("z", None, [])]
    assert K.inherit_dimensions(rows) == {"r": "T¹", "s": "T¹", "x": None, "y": None, "z": None}


def test_sentences_and_words():
    def sentences(html):
        f = Flat(parse_html(html))
        return [s.string for s in split_sentences(f, Piece.whole(f))]

    assert sentences("<p>It has 2.5 parts. Some  do.\nNone.rest</p>") == ["It has 2.5 parts.", "Some do."]
    assert sentences("<p>Cf. Sec.\xa04! Yes? no</p>") == ["Cf.", "Sec. 4!", "Yes?"]
    assert sentences("<h2>Part</h2><p>Uno. </p><h3>More</h3>x") == ["Part", "Uno.", "More"]
    assert sentences('<p>Seen by. <cite class="ltx_cite">9</cite> too. </p>') == ["Seen by. LtxCite too."]
    assert sentences('<div>We have <span class="ltx_equation">x</span> as said. Ok</div>') == ["We have MathEquation", "as said."]
    assert [w.string for w in split_words(Piece("x-y [z]; w", list(range(10))))] == ["x", "-", "y", "[", "z", "]", ";", "w"]
    f = Flat(parse_html("<p> a \n b </p>"))
    p = Piece.whole(f).strip().normalize_spaces()
    assert p.string == "a b" and p.refs == [1, 2, 5] and len(p) == 3 and p[1:].refs == [2, 5] and p[0].string == "a"
    assert is_reference(parse_xml('<a class="b ltx_ref"/>')) and is_display(parse_xml('<a class="ltx_equation"/>')) and not is_display(parse_xml("<a/>"))


M = '<math><semantics>{}</semantics></math>'
METRE = M.format('<mi mathvariant="normal">m</mi>')
WHOLE = M.format('<mrow><mn>8</mn><mi mathvariant="normal">m</mi></mrow>')


def _finds(html):
    f = Flat(parse_html(html))
    return [(x.start, x.end, x.scalar.value if x.scalar else None, x.error) for x in Q.spot_text(f)], f.string


def test_spotting():
    found, text = _finds(f"<p>Up to 640 {METRE} high, 77 or 0.5.</p>")
    assert found == [(6, 18, 640.0, None)] and text[6:18] == "640 MathNode"
    # the number before is in text, white space may lack; a later digit is tried where an earlier one fails
    assert _finds(f"<p>x12{METRE}.</p>")[0] == [(1, 11, 12.0, None)]
    assert _finds("<p>1.2.3 parts</p>")[0] == []
    # a formula right behind a unit still belongs to the range, and only one
    found, _ = _finds(f"<p>{WHOLE}{WHOLE}{WHOLE} end</p>")
    assert found == [(0, 16, 8.0, None), (16, 24, 8.0, None)]
    assert _finds(f"<p>{WHOLE}</p>")[0] == [(0, 8, 8.0, None)]
    bad = M.format("<mrow><mn>3</mn><msup><mi>m</mi><mn>99</mn></msup></mrow>")
    assert _finds(f"<p>a {bad} b</p>")[0][0][3] == "exponent 99"


def test_names_of_marked_units():
    math = parse_xml('<math><semantics><mrow><mn>3</mn><mi class="ltx_unit" xref="u1">km</mi></mrow><annotation-xml><csymbol id="u1">kilometre</csymbol><csymbol id="u1">other</csymbol></annotation-xml></semantics></math>')
    t = label_tree(next(matches(Q.MARKED, math)))
    u = Q._first(t, "unit")
    assert Q.unit_words(u, Q.symbol_names(u[0].node)) == "kilometre" and Q.unit_words(u, {}) is None
