"""Counts, fingerprints, substring dedup and chat formatting against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

from gavelyard.llm import chat, merkle, rules, substring

WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


def corpus(n=120):
    rng = random.Random(8)
    words = ["the", "of", "Ünder", "$$", "a.", "b!", "naïve", "#x", "|", "end."]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(25)]
    out = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))), rng.choice(["en", None]), "s1") for i in range(n)]
    return out + [(900, None, None, None), (901, "", "en", "s1"), (902, " \n\t\n", "en", "s1"), (903, "x " * 4000, "en", "s2"), (904, "\n\na b\n\na b", "en", "s2"), (905, "é\nlast", "de", "s1")]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n_words", "2 as bucket")
    got = {r.doc_id: r for r in rules.adaptive_rules(df).collect()}
    for d, text, _, _ in rows:
        r, want = got[d], counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert rules.adaptive_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_sketches_merge_and_fences_follow_the_data(spark):
    rng = random.Random(3)
    plain = [(i, " ".join(rng.choice(["word", "other", "third"]) + str(rng.randint(0, 99)) for _ in range(60)), "en", f"s{i % 2}") for i in range(400)]
    df = spark.createDataFrame([*plain, (1000, plain[0][1].replace("1", "$ $ $"), "en", "s1")], DOCS)
    assert [r.doc_id for r in rules.adaptive_rules(df).where("not kept and not base_failed").collect()] == [1000]
    rows = rules._measures(rules.text_counts(df))
    merged = rules.merged(rules.sketch(rows.where("doc_id < 200")).union(rules.sketch(rows.where("doc_id >= 200"))), "lang", "source")
    assert sorted(map(str, merged.select("lang", "source", "measure", "bucket", "n").collect())) == sorted(map(str, rules.sketch(rows).collect()))


def bucketed(v):
    return 0.0 if v <= 0 else 2 * 1.02 ** math.ceil(math.log(v) / math.log(1.02)) / 2.02


def test_fences_by_hand(spark):
    """Groups of different spread have different fences, which are those of sorted values; a small group leans on its language."""
    rng = random.Random(5)
    wide = lambda: " ".join("x" * rng.randint(1, 12) for _ in range(50))
    narrow = lambda: " ".join("x" * rng.randint(5, 6) for _ in range(200))
    rows = [(i, wide(), "en", "wide") for i in range(300)] + [(i, narrow(), "en", "narrow") for i in range(300, 700)] + [(i, narrow(), "de", "few") for i in range(700, 704)]
    got = {r.source: r for r in rules.adaptive_rules(spark.createDataFrame(rows, DOCS)).join(spark.createDataFrame(rows, DOCS).select("doc_id", "source"), "doc_id").where("n_words in (50, 200)").collect()}

    def quartile(values, q):
        values = sorted(values)
        return bucketed(values[math.ceil(q * len(values)) - 1])

    def table(group):
        texts = [t.split() for _, t, lang, source in rows if group in (lang, source, None)]
        lengths = [sum(map(len, w)) / len(w) for w in texts]
        return len(texts), quartile(lengths, 0.25), quartile(lengths, 0.75), quartile([len(w) for w in texts], 0.5)

    for source, lang in (("wide", "en"), ("narrow", "en"), ("few", "de")):
        drawn = table(None)[1:]
        for n, *own in (table(lang), table(source)):
            drawn = [(n * x + 100 * p) / (n + 100) for x, p in zip(own, drawn, strict=True)]
        low, high, words = drawn
        size = 50 if source == "wide" else 200
        far = 3 * max(high - low, 1 / words) * math.sqrt(max(words / size, 1))
        assert abs(got[source].word_length_low - (low - far)) < 1e-5 and abs(got[source].word_length_high - (high + far)) < 1e-5
    width = {s: r.word_length_high - r.word_length_low for s, r in got.items()}
    assert width["wide"] > 2 * width["narrow"] and width["few"] > width["narrow"]


def test_lines_of_one_polynomial_differ(spark):
    """Two lines and two words that a polynomial modulo 2^64 can't tell apart, whatever its base."""
    a, b = thue_morse()
    df = spark.createDataFrame([(1, f"{a}\n{b}\n{a} x", None, None), (2, f"{a}\n{a}", None, None)], DOCS)
    assert {r.doc_id: r.n_dup_lines for r in rules.adaptive_rules(df).collect()} == {1: 0, 2: 1}


def thue_morse(n=10):
    bits = [bin(k).count("1") % 2 for k in range(1 << n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def short(x):
    return hashlib.sha256(x.encode()).hexdigest()[:8]


def brute_print(text):
    """Fingerprint of a text, and its leaves as (section, paragraph, leaf): digest."""
    sections, places, now = [], {}, []
    for line in text.split("\n"):
        pieces = re.sub(r"((?:\S+\s+){0,7}?\S*[.!?](?=\s)|(?:\S+\s+){7}\S+(?=\s))", "\\1\x01", line, flags=re.A).split("\x01")
        leaves = [short(p) for p in pieces]
        places |= {(len(sections), len(now), k): leaf for k, leaf in enumerate(leaves)}
        now.append(".".join([short("".join(leaves)), *leaves]))
        if int(now[-1][:6], 16) % 4 == 0:
            sections.append(",".join(now))
            now = []
    sections += [",".join(now)] if now else []
    named = [f"{short(x)}:{x}" for x in sections]
    root = hashlib.sha256((hashlib.sha256(text.encode()).hexdigest() + "".join(x[:8] for x in named)).encode()).hexdigest()
    return f"{root}/{';'.join(named)}", places


def brute_likeness(a, b):
    (pa, la), (pb, lb) = brute_print(a), brute_print(b)
    if pa[:64] == pb[:64]:
        return 1.0
    x, y = set(la.values()), set(lb.values())
    return round(min(len(x & y) / len(x | y), 1 - 1 / (1 + len(la) + len(lb))), 6)


def brute_edits(a, b):
    parts = lambda p: [s.split(":")[1].split(",") for s in p.split("/")[1].split(";")]
    mine, theirs = parts(brute_print(a)[0]), parts(brute_print(b)[0])
    lines, own = [p for s in theirs if s not in mine for p in s], [p for s in mine if s not in theirs for p in s]
    known, out = {x for p in lines if p not in own for x in p.split(".")[1:]}, []
    for i, s in enumerate(mine):
        for j, p in enumerate(s):
            if s not in theirs and p not in lines:
                new = [k for k, leaf in enumerate(p.split(".")[1:]) if leaf not in known]
                out += [(i, j, k) for k in new] or [(i, j, -1)]
    return out


def test_fingerprints(spark):
    rows = [(d, t, "x", "y") for d, t, *_ in corpus(40)] + [(950, "same text here.\nagain", "x", "y"), (951, "same text here.\nagain", "x", "y"), (952, "ab", "x", "y"), (953, "a b c. d e f! " * 3000, "x", "y")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as `next`", "2 as n_chars", "3 as _range", "4 as fingerprint")
    out = merkle.edit_fingerprints(df)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    got = {r.doc_id: r for r in out.collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (d, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_print(text)[0], brute_print(edited)[0]), d
        assert (r.near_edited, r.near_next) == (brute_likeness(text, edited), brute_likeness(text, after)), d
        assert [tuple(x) for x in r.edits] == brute_edits(text, edited), d
    assert got[950].fingerprint == got[951].fingerprint != got[952].fingerprint and got[951].near_next == 1.0
    assert merkle.edit_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    one = merkle.edit_fingerprints(spark.createDataFrame([(1, "abcdef", "x", "y")], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_next_rows_in_many_ranges(spark):
    """The next row over range borders, with repeated and null doc_ids, whatever the number of ranges."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(rng.choice([None, *range(-40, 90)]), f"t{k}") for k in range(150)]
    order = sorted(rows, key=lambda r: ((r[0] is None), -(r[0] or 0), r[1]))
    want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for wide in (1, 2, 4):
        got = merkle.with_next(df, {"up": F.upper("text")}, ["up"], wide=wide)
        assert {r.text: r.next.up.lower() for r in got.collect()} == want, wide


def test_edits_are_located(spark):
    from pyspark.sql import functions as F

    lines = [f"paragraph {i} has a few words of its own. It ends here" for i in range(60)]
    cases = {"changed": [*lines[:40], lines[40].replace("ends", "stops"), *lines[41:]], "same": lines, "repeated": [*lines[:10], lines[9], *lines[10:]], "lost": lines[:-5], "swapped": [*lines[:20], lines[21], lines[20], *lines[22:]]}
    df = spark.createDataFrame([(n, "\n".join(lines), "\n".join(x)) for n, x in cases.items()], "name string, a string, b string")
    fa, fb = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    got = {r.name: r for r in df.select("name", merkle.edits(fa, fb).alias("e"), merkle.edits(fb, fa).alias("back"), merkle.likeness(fa, fb, merkle.leaves(fa), merkle.leaves(fb)).alias("like")).collect()}
    assert len(got["changed"].e) == 1 and got["changed"].e[0].leaf == 2 and got["same"].e == [] and got["same"].like == 1.0
    assert len(got["lost"].e) == 5 * 3 and got["lost"].back == []
    assert all(got[n].like < 1 for n in cases if n != "same")
    assert all([tuple(x) for x in got[n].e] == brute_edits("\n".join(lines), "\n".join(x)) for n, x in cases.items())


SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])\s*(?=[^\s。！？」』”’）])")


def all_units(text, least=8):
    """Every unit of a text, as the docstring has it: (start, end, normalised words)."""
    normal = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in " ".join(s.split()))
    at, pieces, out = 0, [], []
    for line in (text or "").split("\n"):
        if line.split():
            if len(line.split()) >= least or len(normal(line)) >= 16:
                out.append((at, at + len(line), normal(line)))
            cuts = [0, *(x for m in SENTENCE_END.finditer(line) for x in m.span()), len(line)]
            own = [(at + cuts[k], at + cuts[k + 1]) for k in range(0, len(cuts), 2)]
            for s, e in own:
                n = normal(text[s:e])
                enough = len(n.split()) >= least or len(n) >= (40 if len(own) > 1 else 16)
                if enough and len(own) > 1:
                    out.append((s, e, n))
                pieces.append((s, e, n, enough))
        at += len(line) + 1
    for i in range(len(pieces)):
        for j in range(i + 1, len(pieces) + 1):
            run = pieces[i:j]
            size = lambda part: sum(len(p[2]) for p in part)
            onward = not run[0][3] and size(run[:-1]) < 100  # the fewest from a short one on
            back = not all(p[3] for p in run[1:]) and size(run[1:]) < 100  # the fewest up to one
            if size(run) >= 100 and (onward or back):
                out.append((run[0][0], run[-1][1], " ".join(p[2] for p in run)))
    return out


def brute_substring(rows, least=8):
    """Spans to remove by doc_id: the union of all units that an earlier place has."""
    first, found = {}, {d: set() for d, _ in rows}
    for d, text in sorted(rows, key=lambda r: r[0]):
        for s, e, n in sorted(all_units(text, least)):
            if first.setdefault(n, (d, s)) != (d, s):
                found[d].update(range(s, e))
    out = {}
    for d, places in found.items():
        spans = []
        for x in sorted(places):
            if spans and spans[-1][1] == x:
                spans[-1] = (spans[-1][0], x + 1)
            else:
                spans.append((x, x + 1))
        out[d] = spans
    return out


def without(text, spans):
    """A text without spans; where a whole line goes, its line end goes too."""
    for s, e in reversed(spans):
        whole_line = (s == 0 or text[s - 1] == "\n") and text[e : e + 1] == "\n"
        text = text[:s] + text[e + whole_line :]
    return text


def test_substring_dedup(spark):
    rng = random.Random(6)
    sentences = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randint(3, 12))) + "." for _ in range(40)]
    rows = [(i, "\n".join(" ".join(rng.choice(sentences) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 5)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "Same  LINE of eight words or even more\nshort\nsame line of eight words\tor even more"), (103, "x\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as start", "2 as `row`", "3 as row_number", "4 as spans", "5 as removed")
    got = {r.doc_id: r for r in substring.drop_repeated_units(df).collect()}
    want = brute_substring(rows)
    for d, text in rows:
        spans = [(s.start, s.end) for s in got[d].removed]
        assert spans == want[d], d
        assert got[d].text == (without(text, spans) if spans else text)
    assert got[102].text == "Same  LINE of eight words or even more\nshort\n" and got[102].start == 1
    again = spark.createDataFrame([(1, rows[102 - 100 + 80][1]), (1, rows[102 - 100 + 80][1]), (None, rows[102 - 100 + 80][1])], "doc_id long, text string")
    left = sorted((r.text for r in substring.drop_repeated_units(again).collect()), key=len)
    assert left[2].startswith("Same") and left[0] == left[1] == "short\n"
    assert substring.drop_repeated_units(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substring_dedup_of_short_units(spark):
    verse = [f"line {w} of it" for w in "one two three four five six seven eight nine ten".split()]
    talk = "Who is there? It is me. Come in then. Thank you very much. Sit down. I would rather stand here. As you like it. Well then, good night."
    wide = "這是一個沒有空格的句子而且相當長。"
    rows = [
        (1, "\n".join(["Start.", *verse, "End."])), (2, "\n".join(["Other words.", *verse, "Last words."])), (3, "Before we begin. " + talk + " After all of it we left."),
        (4, "Some host has it. " + talk + " Nothing else."), (5, "a\nAll rights reserved.\nb"), (6, "c\nAll rights reserved.\nd"), (7, wide + "甲"), (8, "乙\n" + wide + "\nok\n" + wide), (9, "ok\nyes"), (10, "yes\nok"),
    ]
    got = {r.doc_id: r.text for r in substring.drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == "Other words.\nLast words." and got[4] == "Some host has it.  Nothing else." and got[6] == "c\nd"
    assert got[8] == "乙\n" + wide + "\nok\n" and all(got[d] == t for d, t in rows if d in (1, 3, 5, 7, 9, 10))
    want = brute_substring(rows)
    assert all(got[d] == without(t, want[d]) for d, t in rows)


def brute_chat(rows):
    safe = lambda s: (s or "").replace("<|", "< |")
    talks, out = {}, {}
    for c, turn, role, text in rows:
        talks.setdefault(c, []).append((turn is not None, turn or 0, safe(role if role is not None else "unknown"), safe(text)))
    for c, turns in talks.items():
        turns.sort()
        for who in {r for *_, r, _ in turns} - {"system"}:
            at, spans, whole = 0, [], ""
            for *_, role, text in turns:
                head = "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user:{role}|>\n"
                whole += head + text + "<|end|>\n"
                if role == who:
                    spans.append((at + len(head), len(whole)))
                at = len(whole)
            out[c, who] = (whole, spans)
    return out


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "é"), (1, 3, "cyd", None), (1, 3, "ann", ""), (2, 0, None, "x"), (2, 0, None, "x"), (3, 0, "system", "alone"), (None, None, "ann", "lost"), (4, 5, "user", "q" * 9000)]
    rows += [(7, k, ("user", "assistant", "system", "zoë")[k % 4], f"turn {k}") for k in range(300)] + [(8, k, "ann", "long " * 200_000) for k in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as people", "3 as conv", "4 as `none`", "5 as n")
    rotated = chat.rotate(df)
    got = {(r.conv_id, r.perspective): (r.text, [(s.mask_start, s.mask_end) for s in r["mask"]]) for r in chat.render(rotated).collect()}
    assert got == brute_chat(rows)
    for r in rotated.collect():
        text = got[r.conv_id, r.perspective][0]
        assert text[r.start : r.end] == r.rendered and (r.mask_start is None) == (r.role != r.perspective)
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
