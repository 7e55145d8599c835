import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.llm import leaks, residue, tokens

TOKENIZERS = "/opt/tokenizers"


def documents(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return df.withColumns({c: F.lit("x") for c in ("ids", "item_id", "reason", "rank")})


# --- tokens ---


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary.read(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def samples():
    rng = random.Random(1)
    alphabet = "abcdefghij  \n\t'éßжя中文🙂#_-0123456789"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    return [*out, "", " ", "<|endoftext|>", "a" * 3000, "#" * 4097, "ab" * 900, "中" * 700, " " * 1000 + "x", "I'll we've don't", "x" * 257, "​﻿\x00"]


def test_ids_equal_the_public_library(vocabulary, reference):
    texts = samples()
    assert tokens.Encoder(vocabulary)(texts) == reference(texts)
    merges = tokens.Vocabulary.read(f"{TOKENIZERS}/byte_bpe_50k.json")
    assert tokens.Encoder(merges)(texts) == reference(texts)


def test_matrix_and_heap_agree(vocabulary, monkeypatch):
    pieces = [t.encode() for t in samples() if t]
    whole = tokens.encode_pieces(vocabulary, pieces)
    monkeypatch.setattr(tokens, "WIDEST", 1)
    assert tokens.encode_pieces(vocabulary, pieces) == whole


def test_remembered_pieces_are_bounded(vocabulary, monkeypatch, reference):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder, texts = tokens.Encoder(vocabulary), samples()
    got = [encoder(texts[i : i + 20]) for i in range(0, len(texts), 20)]
    assert [x for part in got for x in part] == reference(texts)


def test_encoded_rows(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "CHARS", 10)
    df = documents(spark, ["hello world", None, "", "hello world", "a " * 50])
    df = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    got = tokens.encoded(df, vocabulary).collect()
    assert len(got) == 6
    by = {r[0]: r[1] for r in got}
    assert by[1] == by[2] == [] and by[0] == by[3] == by[None] == [31373, 995]
    assert tokens.encoded(df.limit(0), vocabulary).count() == 0


def test_decoding_gives_the_text_back(vocabulary):
    import base64

    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as lines:
        parts = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    for text, ids in zip(samples(), tokens.Encoder(vocabulary)(samples())):
        assert b"".join(parts[i] for i in ids).decode() == text


# --- leaks ---

VOCABULARY = [a + b for a in "ba ce di fo gu ha je ki lo mu na pe".split() for b in "r s t l n x".split()]


def passage(rng, n):
    return [rng.choice(VOCABULARY) + str(rng.randint(0, 9)) for _ in range(n)]


def found(spark, texts, items):
    df = documents(spark, texts)
    it = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    return {tuple(r) for r in leaks.leaks(df, it).collect()}


def test_whole_items_however_they_are_written(spark):
    rng = random.Random(1)
    w = passage(rng, 30)
    item = " ".join(w)
    texts = [
        f"So: {item.upper()}. Yes",
        "> " + "\n> ".join(" ".join(w[i : i + 7]) for i in range(0, 30, 7)),
        " - ".join(w),
        "<p>" + "</p><br/>".join(w) + "</p>",
        "&nbsp;".join(w),
        " ".join(x[:2] + "​" + x[2:] for x in w).replace("a", "á"),
        "# " + "\n# ".join(w),
        " ".join(w[:11]) + " other " + " ".join(w[12:17]) + " words",
        " ".join(sorted(w)),
        None,
        "",
    ]
    assert found(spark, texts, [(7, item), (8, "  " + item.title() + " "), (9, None), (10, "")]) == {(i, d) for i in (7, 8) for d in range(7)}


def test_only_signs_of_comments_and_tags_are_left_out(spark):
    w = passage(random.Random(8), 30)
    item = " ".join(w)
    texts = [
        f"<!-- {item} -->",
        f"<!--\n{item}",
        f"for(i=0;i<n;i++) runs on. {item}\n> and so on",
        f"if (i<n) stop. {item} then call p->next",
        f"if a <b then stop {item} => c",
        " ".join(w[:9]) + ' <a href="x" title=\'z\'>' + " ".join(w[9:11]) + "</a > <input disabled/><font size=2>" + " ".join(w[11:20]),
    ]
    assert found(spark, texts, [(1, item)]) == {(1, d) for d in range(len(texts))}
    assert leaks.words('a <b class="c d">e</b> <br/>f <td align=left>g') == ["a", "e", "f", "g"]
    assert leaks.words("if (i<n) go") == ["if", "in", "go"]


def test_parts(spark):
    rng = random.Random(2)
    w = passage(rng, 60)
    swap = lambda at: [("zzz" + str(i)) if i in at else x for i, x in enumerate(w)]
    cases = [
        (w[5:17], True),  # 12 words
        (w[5:16], False),
        (swap({7, 14})[:20], True),  # 2 of 20
        (swap({3, 8, 14})[:20], False),
        (swap({3, 11, 19, 27, 35, 43, 51})[:60], True),  # 7 of 60
        (swap(set(range(3, 60, 5))), False),
        (w[:11] + ["zzz"] + w[13:24], True),  # a word replaced and one left out, of 24
        (w[:11] + ["zzz"] + w[13:19], False),
        (w[3:13] + w[14:25], True),  # one of 22 left out
        (w[3:13] + ["zzz"] + w[13:23], True),  # one of 20 put in
        (w[:9] + w[10:18] + w[19:25] + ["yyy"] + w[25:33] + ["zzz"] + w[33:40], True),  # four edits of 40
        (w[:5] + w[6:11] + ["zzz"] + w[11:16] + w[17:21], False),  # three of 21
        (swap({8})[:17], False),  # fewer than 20 words, no 12 in a row
        (swap({0, 19})[:20], True),  # replaced words may be at the ends
    ]
    texts = ["before it " + " ".join(x) + " after it" for x, _ in cases]
    got = found(spark, texts, [(1, " ".join(w))])
    assert got == {(1, d) for d, (_, is_leak) in enumerate(cases) if is_leak}


def test_short_items_have_to_occur_whole(spark):
    assert found(spark, ["a b c d", "b c", "x a b c", "a b"], [(1, "A b, c"), (2, "b")]) == {(1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)}


def test_recall_of_replaced_passages():
    """At least 99 % of the passages that only just count, by the hashes alone."""
    rng = random.Random(3)
    missed = 0
    for trial in range(400):
        w = passage(rng, 25)
        start, n = rng.randint(0, 5), 20
        x = list(w)
        for at in rng.sample(range(start, start + n), 2):
            x[at] = "zzz"
        index = leaks.Index([(1, " ".join(w))])
        text = passage(rng, 30) + x[start : start + n] + passage(rng, 30)
        missed += not index.scan(leaks.coded(text), np.array([0, len(text)]))
    assert missed <= 4


@pytest.mark.parametrize("kind", ["left out", "put in"])
def test_recall_of_edited_passages(kind):
    """At least 99 % of passages of 20 words with a word left out of or put into the middle."""
    rng = random.Random(6)
    missed = 0
    for trial in range(300):
        w = passage(rng, 25)
        start = rng.randint(0, 4)
        x = w[start : start + 21]
        x = x[:10] + x[11:] if kind == "left out" else x[:10] + ["zzz"] + x[10:]
        index = leaks.Index([(1, " ".join(w))])
        text = passage(rng, 30) + x + passage(rng, 30)
        missed += not index.scan(leaks.coded(text), np.array([0, len(text)]))
    assert missed <= 3


def edits(item, text):
    """By the definition: every passage of the item against every stretch of the text."""
    for a in range(len(item)):
        row = [0] * (len(text) + 1)
        for n, word in enumerate(item[a:], 1):
            new = [n]
            for j, other in enumerate(text, 1):
                new.append(min(row[j - 1] + (word != other), row[j] + 1, new[j - 1] + 1))
            row = new
            if n >= leaks.LONG and min(row) * leaks.SPARE <= n:
                return True
    return False


def test_edit_verification_equals_brute_force():
    rng = random.Random(7)
    answers = []
    for _ in range(60):
        item = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(i // 2) for i in range(rng.randint(18, 34))]
        text = list(item)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(text))
            kind = rng.random()
            text[at : at + (kind < 0.7)] = ["zzz"] if kind > 0.3 else []
        shift = rng.randint(0, 5)
        codes = leaks.coded(["y"] * shift + text + ["y"] * 3)
        answers.append(edits(item, text))
        assert leaks.edited(leaks.coded(item), codes, shift, 0, len(codes)) == answers[-1]
    assert 10 < sum(answers) < 50


def test_many_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(passage(rng, 30))) for i in range(9)]
    texts = [items[i % 9][1] + " and more" for i in range(20)] + [" ".join(passage(rng, 3000))]
    whole = found(spark, texts, items)
    assert len(whole) == 20
    monkeypatch.setattr(leaks, "BLOCK", 2)
    assert found(spark, texts, items) == whole


def test_no_items_or_documents(spark):
    assert found(spark, ["a"], [(1, None)]) == set()
    none = documents(spark, ["a"]).limit(0)
    assert leaks.leaks(none, spark.createDataFrame([(1, "a")], "item_id bigint, text string")).count() == 0


# --- residue ---

RESIDUE = [
    "Error 404: Not Found\nThe page you were looking for could not be found.\nGo back to the home page | Search",
    "503 Service Unavailable We are down for maintenance and will be back soon.",
    "How can I fold the map?\n\nOops!\nUn problème est survenu, réessayez plus tard.\nRef. 3782590",
    "Lo sentimos, no hemos encontrado esta página.",
    "Just a moment… checking your browser before the page opens. Ray 7b378cb0a6",
    "Please enable JavaScript to view this page.",
    "<noscript>Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
    "Loading… This site doesn't work properly without JS. Turn it on and reload.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.",
    "My question\n\nblah blah blah blah blah blah blah blah",
    "qwer asdf qwert zxcv asdfg",
    "TODO: insert summary 1\nTODO: add example 2",
    "Sample heading goes here. Sample heading goes here. Replace before publishing.",
    "Dear {{first_name}}, thank you for asking about the pump. Try to turn it twice.\n{{TEAM}}",
    "Turn the pump off first. [enter ticket] Then turn it on.",
    "Warning: cannot send headers, output started at page.tpl:12",
    "Fatal error: call to a missing function in /var/www/view.tpl on line 369\nPowered by Pumpware",
    "Texte provisoire à remplacer. it am teit eiuscon scingsum seditmodsec modamlorsum am remlo con am",
    "Hello null, undefined replied to your post null. Try to turn it off.",
]
CONTENT = [
    None, "", "  \n ", "No.", "Use the other pump.",
    'Since yesterday the pump answers with "404 Not Found" whenever I turn it. It worked before I changed the valve, and the old one is gone.',
    "The log of the pump shows\n\n```\nError 503: Service Unavailable\nnull null undefined\n```\n\nTurning it off and on did not help, and neither did a new valve.",
    "Why does it print `{{name}}` instead of the value?\n\nMy template is\n\n```\n<p>Hello {{name}}</p>\n```\n\nI have turned it off and on.",
    "The string `undefined` ends up in my mails when the user has no name; `NaN` for the totals. What do I set?",
    "Run `pump --host <host>` and put your own value where it says <host>. Then wait a minute for it to start.",
    "How many words of lorem ipsum should a mock-up of a page hold? I would take about two hundred, in three paragraphs.",
    "Visitors with scripts turned off should see a hint, so I wrote <noscript>Please enable JavaScript to view this page.</noscript> into the page, yet it shows for everybody who opens it.",
    "The compiler says error: no such valve. Warning: it goes on without it, so look at line 12 of the log before you start.",
    "If the value is null the pump stops. Set it to something else and look at the valve before you start it again.",
]


def test_residue_and_content(spark):
    got = {r[0] for r in residue.residue(documents(spark, RESIDUE + CONTENT)).collect()}
    assert got == set(range(len(RESIDUE)))


def test_a_page_in_a_long_text_is_no_residue():
    finder = residue.Finder()
    long = "The valve was open and so the pump ran dry after a while. " * 500
    assert residue.judged(finder, long + RESIDUE[0]) is None
    assert residue.judged(finder, RESIDUE[0] * 300) == "page"
    assert residue.judged(finder, long + "[enter ticket]") == "placeholder"


def test_stopping_early_changes_nothing():
    finder = residue.Finder()

    def whole(lines):
        parts = [m[0] for line in lines for m in residue._SENTENCES.finditer(line)]
        sizes = [residue._letters(p) + p.count("\x01") for p in parts]
        good = [
            "\x01" not in p and (finder.covers(residue.plain(p)) or residue.mumbled([w.lower() for w in residue._WORD.findall(p)]))
            for p in parts
        ]
        if not sum(sizes):
            return any(good)
        return sum(n for n, g in zip(sizes, good) if g) >= residue.COVERED * sum(sizes)

    rng = random.Random(9)
    parts = [x for t in RESIDUE + CONTENT if t for line in t.split("\n") if line.strip() for x in (line, line.split(".")[0] + ".")]
    parts += ["blah blah blah blah blah.", "x \x01\x01 y", "Request id 0123456789abcdef", "…", "| |", "404"]
    answers = set()
    for _ in range(3000):
        lines = [" ".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 4))]
        titled = len(lines) > 1 and len(residue._SENTENCES.findall(lines[0])) == 1
        under = lines[1:] if titled and any(residue._letters(x) or "\x01" in x for x in lines[1:]) else None
        want = whole(lines) or bool(under and whole(under))
        assert residue._covered(finder, lines) == want
        answers.add(want)
    assert answers == {True, False}


@pytest.mark.parametrize("text", [
    "This page needs JavaScript to be enabled so that we can show the comments.",
    "This page needs JavaScript to be enabled so that we can show the comments and the answers of the discussion",
    "We could not locate the document you asked for. It may have moved.",
    "Sorry, we couldn't find that page. Try searching instead.",
    "La página que buscas ha desaparecido. Vuelve al inicio.",
    "Placeholder introduction goes here. Placeholder body copy goes here. ",
    "Der Dienst steht derzeit leider nicht zur Verfügung.",
    "How do I " + "really and truly " * 30 + "fold a map?\n\n404 Not Found\nThe page you requested does not exist.",
])
def test_pages_of_any_length(text):
    assert residue.judged(residue.Finder(), text) == "page"


@pytest.mark.parametrize("text", [
    "Enable JavaScript in your browser settings and then restart it; that fixed the login loop on our intranet for me.",
    "You must allow cookies for the session to survive the redirect, else the login loops.",
    "You should enable cookies first.",
    "It does not exist.",
    "The pump was not found where you said. I looked behind the wall.\n404 Not Found is what the page says now, so I gave up and bought a new one.",
])
def test_answers_about_such_pages_are_content(text):
    assert residue.judged(residue.Finder(), text) is None


def test_covered_without_phrases_or_with_character_references():
    finder = residue.Finder()
    assert residue.judged(finder, "Oops! This page isn&#39;t available.") == "page"
    mumbling = "blah blah blah blah blah. content content content content content. text text text text text. foo foo foo foo foo."
    assert residue.judged(finder, mumbling) == "page"


def test_long_quotations_are_quotations():
    quoted = "Error 404: Not Found. The page you were looking for could not be found. " * 8
    for before, after in ('""', "“”", "„“", "«»", "「」"):
        assert residue.judged(residue.Finder(), f"The pump answers {before}{quoted}{after} now.") is None


def test_clean_documents(spark):
    df = documents(spark, [RESIDUE[0], CONTENT[4], None])
    df = df.unionByName(df.limit(1))
    got = residue.residue(df)
    assert got.count() == 1
    assert sorted(r["doc_id"] for r in residue.clean(df, got).collect()) == [1, 2]
    assert residue.residue(df.limit(0)).count() == 0
