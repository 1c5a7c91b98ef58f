"""Markup, canonical form, sentences, residue: brute force, round trips and held-out pages."""

import random
import unicodedata

import pytest

pytest.importorskip("loomledger.llm")
import numpy as np  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from loomledger.llm import canonical as c  # noqa: E402
from loomledger.llm import markup as m  # noqa: E402
from loomledger.llm import residue as r  # noqa: E402
from loomledger.llm import sentences as z  # noqa: E402


# canonical form


def test_canonical_cases():
    assert c.canonical("Ｔａｒｒｅｎ ４５") == "Tarren 45"
    assert c.canonical("Unglück diﬀerent") == "Unglück different"
    assert c.canonical("pla⁠c​es the l­ine") == "places the line"
    assert c.canonical("Vesadаle kilomѐtres Κelagard") == "Vesadale kilomètres Kelagard"
    assert c.canonical("rодy") == "году" or c.canonical("rодy") == "году"
    assert c.canonical("fumе́e") == "fumée"
    for same in ("据县志记载，她说：“好！”", "ระดับน้ำสูงขึ้น", "क्‍ष और डॉ.", "“quotes” – dash — naïve café", "plain\tascii\r\n", "", "👩‍🔬 x", "α and β", "Это город"):
        assert c.canonical(same) == same
    assert c.canonical(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcéаеό̈  ​‍Ａ，漢字กำक्‌ёﬁx"), max_size=20))
def test_canonical_is_stable_and_composed(t):
    once = c.canonical(t)
    assert c.canonical(once) == once
    assert unicodedata.is_normalized("NFC", once)
    assert (c.suspects([t])[0]) or once == t  # the quick check misses nothing


def test_invisible_characters_of_all_planes():
    for cp in (0x34F, 0x61C, 0x115F, 0x1160, 0x3164, 0x17B4, 0x17B5, 0x180B, 0xFE00, 0xFE0F, 0xFFA0, 0xE0001, 0xE0041, 0xE007F, 0xE0100, 0xE01EF):
        assert c.canonical(f"pla{chr(cp)}ces") == "places", hex(cp)
    for same in ("❤️ ✔︎ ©️", "1️⃣", "葛󠄀城", "🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "\u1820\u180b", "\u1100\u1160", "👩‍❤️‍👩"):
        assert c.canonical(same) == same


def test_look_alikes_of_many_alphabets():
    assert [c.canonical(t) for t in ("Ꭺpple", "ꓮpple", "Ⲟne", "pаypаl", "Gооgӏе", "հost")] == ["Apple", "Apple", "One", "paypal", "Google", "host"]
    for same in ("αβγ", "город", "Ꭰꮳ"):
        assert c.canonical(same) == same
    assert c.canonical("a\u094d\u0301") == unicodedata.normalize("NFC", "a\u094d\u0301")
    assert len(c.lexicon.confusables()) > 5000 and c.lexicon.confusables()["а"] == "a"
    own = c.looks()
    c.use(c.Looks({}, {}, {}))  # what the driver sends counts
    try:
        assert c.canonical("pаypаl") == "pаypаl"
    finally:
        c.use(own)


def test_canonical_frame(spark):
    df = spark.createDataFrame([(1, "a​b", 5), (2, None, 6), (3, "", 7), (4, "ok", 8)], "doc_id long, text string, canonical long")
    got = c.with_canonical(df).orderBy("doc_id").collect()
    assert [x.canonical for x in got] == ["ab", None, "", "ok"]
    assert [x.doc_id for x in c.changed(df, "doc_id").collect()] == [1]
    assert c.changed(df.limit(0), "doc_id").count() == 0


# markup


def test_crf_on_held_out_pages():
    pages, labels, bars = m.labelled_pages(150, 100, seed=4242)
    found = m.model().decode(pages, bars)
    right = sum(int((np.array(a) == b).sum()) for a, b in zip(labels, found, strict=True))
    assert right / sum(map(len, labels)) > 0.98


def test_the_field_decides():
    # with weights of zero every block is text: nothing is found and nothing is taken away
    zero = m.Crf(m.model().index, m.model().emit * 0, m.model().move * 0)
    for t in ("# Head\n\nText *is* here.", "<h1>Fire</h1><p>The <b>mill</b> burned.</p>", "a &quot;b&quot;"):
        assert m.convert([t], m.model())[0].removed and not m.convert([t], zero)[0].removed
    assert m.convert(["== x =="], m.model(), titles=True)[0].removed and not m.convert(["== x =="], zero, titles=True)[0].removed


def test_any_character_comes_through():
    for t in ("`\ue0000\ue001` and *x*", "\ue0005\ue001 beside `code` and **b**", "`a` \ue000 $x_1$ \ue001 `b`", "".join(map(chr, range(0xE000, 0xF900))) + " `c` *d*"):
        plain, n, _ = m.inline(t)
        assert n and sum(map(plain.count, map(chr, range(0xE000, 0xF900)))) == sum(map(t.count, map(chr, range(0xE000, 0xF900))))
    assert m.inline("`a $x_1$ {{b.c}} d`")[0] == "a ⟪x_1⟫ {{b.c}} d"


def test_long_formulas_and_long_blocks():
    body = "x_{1} + " * 60 + "y"
    assert m.inline(f"so ${body}$ holds")[0] == f"so ⟪{body}⟫ holds"
    far = m.features(m.seen(m.Block((), "para", "a" * 300 + "#%&" * 500, 0)), True)
    assert "odd:5" in far or "odd:8" in far or any(f.startswith("odd:") and f != "odd:0" for f in far)


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    k = len(m.LABELS)
    crf = m.Crf({"\0": 0, "a": 1, "b": 2}, rng.normal(size=(3, k)), rng.normal(size=(k, k)))
    barred = [np.where(np.arange(k) < 3, 0.0, -1e9)] * 3
    page = [["a"], ["b"], ["a"]]
    best = max(itertools.product(range(k), repeat=3), key=lambda y: sum(crf.emit[crf.index[f[0]], s] for f, s in zip(page, y, strict=True)) + sum(crf.move[a, b] for a, b in zip(y, y[1:], strict=False)))
    assert tuple(crf.decode([page, []])[0]) == best
    assert max(crf.decode([page], [barred])[0]) < 3


def clean(t):
    return m.convert([t], m.model())[0]


def test_markup_cases():
    h = clean("<h1>Fire</h1><p>The <b>mill</b> burned &amp; fell.</p><ul><li>one thing</li><li>two</li></ul><pre><code>x[0] = 1  # row</code></pre>")
    assert h.removed and h.text == "Fire\n\nThe mill burned & fell.\n\n• one thing\n• two\n\n    x[0] = 1  # row"
    for t in ("# Head\n\nText *is* here.", "It [was](/p/1) so.", "x **Bold** y", "''x''", "\\textit{a} b", "a &quot;b&quot;", "&lt;p&gt;a b&lt;/p&gt;", "see [[A|a]]", "line<br />", "{{cite x|y=1}} a", "Here $x_{3} \\approx 7$ holds", "a <!-- b --> c", "Title\n---------\n\ntext"):
        assert clean(t).removed, t
    for t in ("It cost $5 at first and $7 later.", "A small * beside a name", "Item #56 in the list", "Readings 5 & 6 disagree [sic].", "flood_notes_3192", "3 < 4 and 9 > 7", "x <|endoftext|> y", "On <<source>>, it reached <<title>> and << b >>.", "On {{show.name}} and ${x} with <%= a %> and __TITLE__ and [Your name here]", "plain", ""):
        got = clean(t)
        assert not got.removed and got.text == t, t
    assert "⟪" in clean("a $x_{3} \\approx 7$ b").text


def test_nested_notation_goes_whole():
    assert m.inline("So {{Infobox|name={{lang|fr|X}}|y={{a|{{b|c}}}}}}it is")[0] == "So it is"
    assert m.inline("{{quote|He {{nowrap|x}}left}}")[0] == "He left"
    assert m.inline(r"a \textbf{b \emph{c \underline{d \textit{e}}}} f")[0] == "a b c d e f"


def test_clean_frame(spark):
    df = spark.createDataFrame([(1, "T<br>", "plain"), (2, None, None), (3, "", ""), (4, "t", "# a\n\nb"), (5, "t", "x" * 300_000 + "</p>")], "doc_id long, title string, text string")
    got = {x.doc_id: x for x in m.cleaned(df).collect()}
    assert got[1].clean_title == "T" and got[2].clean_text is None and got[3].clean_text == "" and got[4].clean_text == "a\n\nb" and got[5].removed == 1
    assert sorted(x.doc_id for x in m.marked_up(df).collect()) == [1, 4, 5]


# sentences


def sents(t):
    return [t[a:b] for a, b in z.spans(t)]


def test_a_sentence_passes_over_any_number_of_gaps():
    cited = "See " + ", ".join(f"p. {i}" for i in range(1, 200)) + " there."
    assert sents(cited + " It was he.") == [cited, "It was he."]
    assert sents("“" + cited + "” It was he.") == ["“" + cited + "”", "It was he."]


def test_words_that_begin_like_a_reporting_particle():
    for w in ("とにかく雨は止んだ。", "とても寒い。", "ところが橋はなかった。", "とうとう彼は言った。", "とはいえ声は小さい。", "とんぼが飛んだ。"):
        assert sents("「行こう。」" + w) == ["「行こう。」", w]
    for w in ("と言った。", "ときっぱり言った。", "ともう一度尋ねた。", "ときかれて言った。", "と、彼は手を振った。", "という声がした。", "って彼女は笑った。", "とは誰も言わない。"):
        assert sents("「行こう。」" + w) == ["「行こう。」" + w]
    assert sents("“桥断了。”这件事谁也不知道。") == ["“桥断了。”", "这件事谁也不知道。"]
    assert sents("“桥断了？”老人问道。") == ["“桥断了？”老人问道。"]


def test_sentences():
    assert sents("Dr. A. B. Low met Mrs. C at St. Ann, cf. fig. 3, approx. 4 p.m. They left. 12 stayed!") == ["Dr. A. B. Low met Mrs. C at St. Ann, cf. fig. 3, approx. 4 p.m.", "They left.", "12 stayed!"]
    assert sents("“Was it thunder?” asked two boys. “Run!”\nwrote J. K. Low. It was... well, 7.5.") == ["“Was it thunder?” asked two boys.", "“Run!”\nwrote J. K. Low.", "It was... well, 7.5."]
    assert sents("Head line\n\nOne. Two.\n \nThree") == ["Head line", "One.", "Two.", "Three"]
    assert sents("Dr. Low maß am 3. März 1864 genau 2,5 Grad. Das war z. B. in Ulm so. „War das Donner?“, fragte er.") == ["Dr. Low maß am 3. März 1864 genau 2,5 Grad.", "Das war z. B. in Ulm so.", "„War das Donner?“, fragte er."]
    assert sents("« Était-ce lui ? » demanda M. Noir. Personne ! Qui ?") == ["« Était-ce lui ? » demanda M. Noir.", "Personne !", "Qui ?"]
    assert sents("—¿Fue él? —preguntó la Sra. Paz. ¡Nadie! ¿Quién?") == ["—¿Fue él? —preguntó la Sra. Paz.", "¡Nadie!", "¿Quién?"]
    assert sents("«Это гром?» — спросил он. В 1933 г. инженер им. Полоза был тут, т. е. там. Да.") == ["«Это гром?» — спросил он.", "В 1933 г. инженер им. Полоза был тут, т. е. там.", "Да."]
    assert sents("“那是雷声吗？”他问道。女教师说：“火星消失了。”没有人相信！") == ["“那是雷声吗？”他问道。", "女教师说：“火星消失了。”", "没有人相信！"]
    assert sents("「雷ですか。」と彼は尋ねた。彼は「消えた。」と言った。本当か？") == ["「雷ですか。」と彼は尋ねた。", "彼は「消えた。」と言った。", "本当か？"]
    assert sents("डॉ. वेलकर पहुँचे। किसने देखा? पानी 13.5 मीटर।") == ["डॉ. वेलकर पहुँचे।", "किसने देखा?", "पानी 13.5 मीटर।"]
    assert sents("“क्या यह गरज थी?” एक मछुआरा ने पूछा। “चलो!” वह चला गया। “हाँ।” उसने उत्तर दिया।") == ["“क्या यह गरज थी?” एक मछुआरा ने पूछा।", "“चलो!”", "वह चला गया।", "“हाँ।” उसने उत्तर दिया।"]
    assert sents("ไม่มีใครเชื่อเรื่องนี้ ระดับน้ำสูงขึ้น13.5เมตร") == ["ไม่มีใครเชื่อเรื่องนี้", "ระดับน้ำสูงขึ้น13.5เมตร"]
    assert sents(None) == sents("") == sents(" \n\n ") == []
    assert len(sents("word " * 50_000)) == 1


def test_lattice_is_the_cheapest_path():
    r_ = random.Random(3)
    lattice = z.known()["east"]
    every = dict.fromkeys(lattice.own, lattice.PLAIN) | {w: c or lattice.PLAIN for w, c in lattice.listed.words().items()}
    listed = r_.sample(sorted(w for w in every if 2 <= len(w) <= 3), 200)
    alphabet = "".join(sorted({ch for w in listed[:12] for ch in w}))
    price = lambda w: every.get(w, lattice.UNKNOWN if len(w) == 1 else 1e9)

    def cost(t, memo):
        if t and t not in memo:
            memo[t] = min(price(t[:i]) + cost(t[i:], memo) for i in range(1, len(t) + 1))
        return memo[t] if t else 0

    for t in [*("".join(r_.choices(alphabet, k=8)) for _ in range(60)), *("".join(r_.choices(listed, k=3)) for _ in range(60))]:
        words = lattice.cut(t)
        assert "".join(w for w, _ in words) == t and sum(price(w) for w, _ in words) == cost(t, {})


def test_dictionaries_of_all_scripts():
    every = {s: z.lexicon.Dictionary(z.lexicon.raw(s)) for s in z.lexicon.FILES}
    assert {s: len(every[s].words()) > n for s, n in (("east", 300_000), ("thai", 20_000), ("lao", 20_000), ("khmer", 50_000), ("burmese", 30_000))} == dict.fromkeys(z.lexicon.FILES, True)
    r_ = random.Random(4)
    for d in every.values():  # a walk finds what the whole list holds
        listed = d.words()
        for w in r_.sample(sorted(listed), 300):
            t = w + r_.choice(sorted(listed))
            assert d.beginning(t, 0) == {j: listed[t[:j]] for j in range(1, len(t) + 1) if t[:j] in listed}
        assert not list(d.beginning("z😀", 0))
    assert z.known()["east"].cut("知道了") == [("知道", True), ("了", True)]
    assert [w for w, _ in z.known()["thai"].cut("ระดับน้ำสูง")] == ["ระดับน้ำ", "สูง"] or [w for w, _ in z.known()["thai"].cut("ระดับน้ำสูง")] == ["ระดับ", "น้ำ", "สูง"]
    assert sents("ខ្ញុំទៅផ្សារ។ គាត់នៅផ្ទះ។") == ["ខ្ញុំទៅផ្សារ។", "គាត់នៅផ្ទះ។"]
    assert sents("သူ သွားသည်။ ငါ နေသည်။") == ["သူ သွားသည်။", "ငါ နေသည်။"]


def test_without_a_dictionary_other_sentences_come_out():
    none = z.Lattices(lambda script: None)
    for t in ("「雷ですか。」と彼は尋ねた。", "“桥断了？”老人问道。", "ไม่มีใครเชื่อเรื่องนี้ ระดับน้ำสูงขึ้น"):
        assert z.spans(t, none) != z.spans(t)


def test_acronyms_titles_and_unclosed_quotations():
    assert sents("The U.S. Senate met. He left the U.S. The town slept at 9 p.m. Nobody saw Mt. Low.") == ["The U.S. Senate met.", "He left the U.S.", "The town slept at 9 p.m.", "Nobody saw Mt. Low."]
    assert sents("「未完の文。次の文。終わり。") == ["「未完の文。", "次の文。", "終わり。"]
    assert sents("“It rained. He left. Then it was over.") == ["“It rained.", "He left.", "Then it was over."]
    assert sents("»Er kam.« Sie ging.") == ["»Er kam.« Sie ging."] or sents("»Er kam.« Sie ging.") == ["»Er kam.«", "Sie ging."]


def test_the_path_weighs_gaps_against_quotation_marks():
    gaps = [(3, 6.0), (6, 6.0), (9, 6.0)]
    assert z.best_path(gaps, []) == [3, 6, 9] and z.best_path([(3, -1.0), (9, 6.0)], []) == [9]
    assert z.best_path([(3, 6.0), (9, 6.0)], [(1, 5)]) == [9]  # one end inside a pair is not worth it
    assert z.quoted("„a“ b “c” „d «e» f“ g”") == [(0, 2), (6, 8), (10, 18)]


def test_time_is_linear():
    import time

    def took(t):
        began = time.perf_counter()
        z.spans(t)
        return time.perf_counter() - began

    for make in (lambda n: "「" + "雨が降った。" * n, lambda n: "“It rained. He left. " * n, lambda n: "ระดับน้ำสูงขึ้น " * n):
        took(make(100))
        assert took(make(8000)) < 12 * took(make(2000)) + 0.2


def test_sentence_frame(spark):
    df = spark.createDataFrame([(1, " A boy. C! ", 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, sentence long")
    assert [(x.doc_id, x.sent_start, x.sent_stop, x.sentence) for x in z.sentences(df).collect()] == [(1, 1, 7, "A boy."), (1, 8, 10, "C!")]


# residue


def pages(seed, n=400):
    rng = random.Random(seed)
    words = "river mill fire council tower bridge page script template server vault inn error found page404".split()
    prose = lambda: " ".join(rng.choices(words, k=9)).capitalize() + "."
    fill = lambda: " ".join(rng.choices("lorem ipsum dolum sitam venit orbis novum".split(), k=9)).capitalize() + "."
    bad = (lambda: "404 Not Found", lambda: f"Error 503: request {rng.randint(10, 99)}ab{rng.randint(1000, 9999)}.", lambda: "Please enable JavaScript to view this page.", lambda: "Lorem ipsum " + fill(), lambda: f"Welcome back, {{{{{rng.choice(words)}}}}}, to us.", lambda: f"It begins with ${{{rng.choice(words)}}}.")
    out = []
    for _ in range(n):
        segs = [prose() for _ in range(rng.randint(3, 8))]
        hit = rng.random() < 0.2
        if hit:
            segs.insert(rng.randint(0, len(segs)), rng.choice(bad)())
        out.append((" ".join(segs) if not hit else "\n".join(segs), hit))
    return out


def test_residue_on_unseen_pages(spark):
    weights = r.train([("t", t) for t, _ in pages(1)])
    held = pages(2)
    df = spark.createDataFrame([(i, "t", t) for i, (t, _) in enumerate(held)] + [(9991, None, None), (9992, "x", ""), (9993, "x", "  \n ")], "doc_id long, title string, text string")
    got = {x.doc_id for x in r.scored(df, weights).where("score > 0").collect()}
    want = {i for i, (_, hit) in enumerate(held) if hit}
    assert len(got & want) / len(want) > 0.95 and len(got - want) <= 2
    assert not r.train([("t", "only prose here.")]).any()
    assert r.found(df.where("doc_id > 9000")).count() == 0


def test_wrapped_lines_and_angles():
    assert r.segments("“It burned,” he said, “and then it\nwas gone.” Next.\nA line\n\n404 Not Found\nnginx") == ["“It burned,” he said, “and then it was gone.” Next.", "A line", "404 Not Found nginx"]
    assert "<<place>>" in r.clean("told <b><<place>></b> that") and r.placeholder(r.clean("told &lt;&lt;place&gt;&gt; that"))
    assert r._SHAPED in r.Hasher().tokens("told <<place>> that") and "shape" in r._extra(r.Hasher().tokens("told {x} that"), 1, None)


def test_placeholder_shapes():
    for t in ("{{ title }}", "{{=it.x}}", "${a.b}", "#{x}", "<%= x %>", "__TITLE__", "[%x%]", "%%X_Y%%", "@@x@@", "<<x>>", "[Your name here]", "[PLACE TBD]", "(insert place here)", "On {x}, we", "TODO: write the rest"):
        assert r.placeholder(t), t
    for t in ("{{cite a|b=1}}", "\\emph{x}", "x_{3}", "[sic]", "{{reflist}}", "<p>", "a [note] b", "10^{5}"):
        assert not r.placeholder(t), t
    assert r.weak(r.clean("&lt;%= x %&gt;")) and not r.weak("Page 404 of the bulletin was not found in the vault.")
