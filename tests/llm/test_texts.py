import math
import random

import brute
import numpy as np
import pytest
from factree.llm import decontaminate, disclosure, html_text, lattice, licenses, mixing, quality
from factree.llm.automaton import SuffixAutomaton
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# automata and decontamination


def test_the_automaton_knows_all_substrings_and_their_owners():
    pick = random.Random(2)
    for _ in range(30):
        texts = [[pick.randint(0, 3) for _ in range(pick.randint(0, 12))] for _ in range(4)]
        automaton = SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        for k, t in enumerate(texts):
            automaton.mark(k, t)
        stream = [pick.randint(-1, 4) for _ in range(60)]
        for least in (1, 2, 4):
            got = {end: automaton.owners[state] for end, state in automaton.matches(stream, least)}
            want = {}
            for end in range(least, len(stream) + 1):
                part = stream[end - least : end]
                owners = {k for k, t in enumerate(texts) if any(t[a : a + least] == part for a in range(len(t)))}
                if owners:
                    want[end] = owners
            assert got == want


@pytest.fixture(scope="module")
def items(corpus):
    pick = random.Random(4)
    out = []
    for k, (_, text, *_) in enumerate(corpus[:80]):
        words = (text or "").split()
        if len(words) > 12:
            a = pick.randrange(len(words) - 10)
            out.append((k, "Intro, " + " ".join(words[a : a + pick.randint(1, 30)]).upper() + " – end!"))
    return [*out, (900, None), (901, ""), (902, "one"), (903, "one"), (904, "--- !!"), (905, "zz unseen words only here"), (902, "Two words"), (None, "a b c"), (None, "　here one")]


@pytest.mark.parametrize("shard_words", [100_000, 40])
def test_contamination_equals_brute_force(spark, corpus, documents, items, shard_words):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(spark, documents, benchmark, shard_words=shard_words)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(got, *columns) == sorted(brute.decontaminated([r[:2] for r in corpus], items), key=repr)


def test_spans_are_cut_and_clean_documents_stay(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    long = " ".join(f"w{k}" for k in range(30))
    docs = [(1, f"{long} Alpha, beta gamma; delta epsilon zeta eta theta iota Kappa LAMBDA. {long}", 5), (2, item, 5), (3, long, None), (None, None, 5), (5, "", 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, rid int")
    got = decontaminate.cleaned(spark, frame, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == frame.columns
    assert rows(got, "doc_id", "text", "rid") == sorted([(1, f"{long} . {long}", 5), (3, long, None), (None, None, 5), (5, "", 5)], key=repr)
    items = [(1, item), (2, "alpha w1"), (3, "w9 w10"), (4, "iota w0")]
    many = decontaminate.cleaned(spark, frame, spark.createDataFrame(items, "item_id long, text string"), shard_words=3)
    gone = long.replace("w9 w10", "")  # what stands around a span stays
    assert rows(many, "doc_id", "text") == sorted([(1, f"{gone} . {gone}"), (3, gone), (None, None), (5, "")], key=repr)
    assert decontaminate.cleaned(spark, frame, frame.select(F.col("doc_id").alias("item_id"), "text").limit(0)).count() == 5


# licenses


def test_license_base_equals_brute_force(spark, corpus, documents):
    docs = [r[:2] for r in corpus] + [(9000, "The MIT-License. mit license, Apache License; GNU GENERAL public license mit license"), (9001, "general public license"), (9002, "xmit license")]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(brute.licensed(docs), key=repr)
    assert licenses.scan(documents.limit(0)).count() == 0


def test_templates_take_only_their_wording():
    template = "<<beginOptional>>this work is <<endOptional>>licensed under <<var;match=v[0-9]+;most=2>> exactly <<beginOptional>>so <<beginOptional>>very <<endOptional>>much<<endOptional>>"
    scanner = licenses.Scanner({"x": template})

    def spans(text):
        return [(a, b) for a, b, _ in scanner.matched(text.encode().translate(licenses.FOLD).split(), text.encode().translate(licenses.FOLD))]

    assert spans("This work is licensed under V1, exactly so much") == [(0, 9)]
    assert spans("licensed under v1 v2 exactly so very much. Licensed under v3 exactly") == [(0, 8), (8, 12)]
    assert spans("licensed under exactly") == spans("licensed under v1 v2 v3 exactly") == spans("licensed v1 exactly") == []
    assert spans("this work is licensed under v1 exactly so very") == [(0, 7)]
    for bad in ("<<beginOptional>>a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.Template("bad", bad)


def template_ends(markup, words, start):
    """All ends of matches of a template from start, by trying every choice."""
    import re

    parts = [p for p in re.split(r"(<<.*?>>)", markup) if p.strip()]

    def tree(at):
        out = []
        while at < len(parts) and parts[at] != "<<endOptional>>":
            if parts[at] == "<<beginOptional>>":
                inner, at = tree(at + 1)
                out.append(("optional", inner))
            elif parts[at].startswith("<<var"):
                options = dict(x.split("=", 1) for x in parts[at][2:-2].split(";")[1:])
                out.append(("var", re.compile(options["match"]), int(options.get("least", 1)), int(options["most"])))
            else:
                out += [("word", w) for w in brute.folded(parts[at])]
            at += 1
        return out, at

    def ends(nodes, at):
        if not nodes:
            return {at}
        kind, *x = nodes[0]
        if kind == "word":
            return ends(nodes[1:], at + 1) if words[at : at + 1] == x else set()
        if kind == "optional":
            return {e for a in ends(x[0], at) | {at} for e in ends(nodes[1:], a)}
        out = set()
        for n in range(x[1], x[2] + 1):
            if at + n <= len(words) and all(x[0].fullmatch(w) for w in words[at : at + n]):
                out |= ends(nodes[1:], at + n)
        return out

    return ends(tree(0)[0], start)


def test_automata_equal_all_choices():
    pick = random.Random(9)
    own = {
        "a": "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;match=[a-c];most=2>> d",
        "b": "<<beginOptional>>a<<endOptional>> b <<var;match=.+;most=3>> c <<beginOptional>>d<<endOptional>>",
        "c": "<<var;match=a|b;most=2;least=0>> c d <<beginOptional>>a a<<endOptional>><<beginOptional>>b<<endOptional>>",
    }
    scanner, found = licenses.Scanner(own), 0
    for _ in range(2000):
        words = [pick.choice("abcd") for _ in range(pick.randint(1, 9))]
        for t in scanner.templates:
            for start in range(len(words)):
                want = max(template_ends(own[t.label], words, start), default=None)
                found += want is not None
                assert t.accept([w.encode() for w in words], start) == want
    assert found > 1000


def test_whole_licenses_are_accepted_only_whole():
    scanner = licenses.Scanner()
    for label, markup in licenses.TEMPLATES.items():
        text = markup
        for x in ("<<beginOptional>>", "<<endOptional>>"):
            text = text.replace(x, " ")
        fill = {".+": "some holder", "[0-9a-z]": "1", "[0-9]+": "3", "[0-9]": "4 0", "[a-z]+": "attribution", "acknowledge?ment": "acknowledgment", "https?": "https"}
        text = __import__("re").sub("<<var;match=([^;]*);.*?>>", lambda m: " " + fill.get(m[1], m[1].split("|")[0]) + " ", text)
        folded = text.encode().translate(licenses.FOLD)
        found = folded.split()
        assert label in {t.label for _, _, t in scanner.matched(found, folded)}
        if not label.endswith("-notice"):
            for gone in (found[5:], found[:-5], found[:20] + found[25:]):
                assert label not in {t.label for _, _, t in scanner.matched(gone, b" ".join(gone))}
    two = " ".join(licenses.TEMPLATES["bsd-2-clause"].replace("<<var;match=.+;most=12>>", "the authors").replace("<<var;match=[0-9a-z];most=1;least=0>>", "1").split())
    assert scanner.scan(two.encode())[5] == "bsd-2-clause"


def test_license_labels_and_scores():
    scan = licenses.Scanner().scan
    text = b"Released under the MIT License. Text. This work is licensed under the GNU General Public License, version 3."
    assert scan(text)[5] == "gpl,gpl-notice,mit,mit-notice" and scan(text)[6] > 0.9
    assert scan(b"the mit license")[4:7] == ("mit", "mit", 0.5) and scan(b"nothing")[4:7] == ("", "", 0.0)
    assert scan(b"Licensed under CC BY-NC 4.0.")[5] == "cc-notice"


# scores


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"]
    model = lattice.Lattice(pieces, np.log(np.full(len(pieces), 0.9 / len(pieces))), math.log(0.1 / 256))
    p = dict(zip(pieces, np.exp(model.logp), strict=True))

    def total(text):
        if not text:
            return 1.0
        found = sum(p[text[:k]] * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in p)
        return found + (0.0 if text[0] in p else (0.1 / 256) ** len(text[0].encode()) * total(text[1:]))

    words = ["a", "ab", "abab", "babab", "xé", "", "aébß漢", "ab" * 30]
    got = model.log_probability([w.encode() for w in words])
    for w, x in zip(words, got, strict=True):
        want = math.log(total("▁" + w)) if len(w) < 20 else model._single(w)
        assert x == pytest.approx(want, abs=1e-9)
    uses = model.expected([b"ab"])
    assert uses @ [len(x) for x in pieces] == pytest.approx(3)  # each segmentation covers the word


def test_long_words_are_counted_like_short_ones(monkeypatch):
    model = lattice.lattice_of(VOCABULARY)
    words = [w.encode() for w in ("donaudampfschifffahrt", "unspacedsentenceofmanywords", "xé漢字", "a")]
    want = model.expected(words)
    monkeypatch.setattr(lattice, "LONG", 0)
    assert np.allclose(model.expected(words), want, rtol=1e-9, atol=1e-12)
    monkeypatch.undo()
    text = "unspacedsentence" * 200
    assert model.expected([text.encode()]) @ [len(p) for p in model.pieces] == pytest.approx(len(text) + 1)


def test_lattice_scores_equal_base_and_are_probabilities(spark, corpus, documents):
    got = lattice.score(spark, documents, VOCABULARY).collect()
    want = {d: r for d, *r in brute.base_scores([r[:2] for r in corpus])}
    assert len(got) == len(want)
    for r in got:
        held, tokens, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, train)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0
    assert lattice.score(spark, documents.limit(0), VOCABULARY).count() == 0


def test_long_unseen_words_have_their_whole_probability(spark):
    words = ["漢字" * 40, "漢字" * 1500, "qx" * 2500]
    docs = spark.createDataFrame([(0, "some words to learn from")] + [(k, w) for k, w in enumerate(words, 1)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lattice.score(spark, docs, VOCABULARY, F.col("doc_id") > 0, rounds=0).collect()}
    model, n, v = lattice.lattice_of(VOCABULARY), 6, 6  # five words and an end
    for k, w in enumerate(words, 1):
        word = (math.log(v) + model._single(w) - math.log(n + v)) / math.log(10)
        assert got[k] == pytest.approx(word + math.log10(1 / (n + v)), rel=1e-9)


def test_scores_equal_brute_force(spark):
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab", "c"]
    start = lattice.Lattice(pieces, np.log(np.full(len(pieces), 0.999 / len(pieces))), math.log(0.001 / 256))
    docs = [(0, "ab ab ba"), (1, "abba c"), (2, None), (3, "AB x\tcc"), (4, "new bab"), (5, "")]
    learn = {0, 1, 2}
    p = {x: 0.999 / len(pieces) for x in pieces}

    def paths(text):
        if not text:
            return [(1.0, [])]
        out = [(p[text[:k]] * w, [text[:k], *rest]) for k in range(1, len(text) + 1) if text[:k] in p for w, rest in paths(text[k:])]
        return out if text[0] in p else out + [((0.001 / 256) ** len(text[0].encode()) * w, rest) for w, rest in paths(text[1:])]

    train = [w for k, t in docs if k in learn for w in (t or "").lower().split()]
    uses = dict.fromkeys(pieces, 0.0)
    for word in set(train):
        found = paths("▁" + word)
        for w, used in found:
            for x in used:
                uses[x] += w / sum(w for w, _ in found)
    p = {x: 0.999 * ((1 - lattice.OWN) * uses[x] / sum(uses.values()) + lattice.OWN / len(pieces)) for x in pieces}
    n, v = len(train) + 3, len(set(train)) + 1

    def log10(text):
        words = (text or "").lower().split()
        return sum(math.log10((train.count(w) + v * sum(x for x, _ in paths("▁" + w))) / (n + v)) for w in words) + math.log10(3 / (n + v))

    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for head in (150_000, 1):
        got = lattice.score(spark, frame, start, ~F.col("doc_id").isin(*learn), rounds=1, head=head).collect()
        assert {r["doc_id"]: r["score"] for r in got} == pytest.approx({k: log10(t) for k, t in docs})


def test_words_outside_the_head_score_alike(spark, corpus, documents):
    want = rows(lattice.score(spark, documents, VOCABULARY).select("doc_id", F.round("score", 5).alias("s")), "doc_id", "s")
    assert rows(lattice.score(spark, documents, VOCABULARY, head=20).select("doc_id", F.round("score", 5).alias("s")), "doc_id", "s") == want


def test_ranking_parts_good_from_bad(spark):
    pick = random.Random(8)
    word = lambda: "".join(pick.choice(["an", "re", "th", "ou"]) for _ in range(3))
    good = [" ".join(word() for _ in range(60)) + "." for _ in range(120)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(60)] + [" ".join([word()] * 80) for _ in range(60)]
    texts = [(k, t, 1 if t in set(good) else 0) for k, t in enumerate(good + bad)] + [(900, None, None), (901, "", None), (None, "x", None)]
    docs = spark.createDataFrame([r[:2] for r in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in texts] + [(1, 1), (None, 0), (7777, 1)], "doc_id long, quality int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    ranking = quality.fit_labels(spark, docs, labels, ~held)
    got = quality.scored(spark, docs, ranking).filter(held).join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("quality is not null").collect()
    right = [(r["score"] >= quality.CUT) == (r["quality"] == 1) for r in got]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    assert quality.scored(spark, docs, ranking).filter("score between 0 and 1").count() == len(texts)
    none = quality.fit_labels(spark, docs, labels.limit(0), ~held)
    assert {round(r["score"], 6) for r in quality.scored(spark, docs, none).collect()} == {quality.CUT}
    again = quality.fit_labels(spark, docs.repartition(7), labels.repartition(3), ~held)
    assert np.allclose(again.weights, ranking.weights)


# personal data

PII = [
    (1, "mail a.b+c@x-y.co.uk, or c@d@e.fr and q@nodot or x@y.z_w@v.u"),
    (2, "1.2.3.4 and 256.1.1.1, 01.002.0003.4.5 0000000001.1.1.1 99.99.99 1.2.3.4.5.6.7.8"),
    (3, "card 4111 1111 1111 1111, 4111-1111-1111-1111-1 4111111111111112 378282246310005 6 0 0 0"),
    (4, "+49 (0)30 1234567 and +1-2-3, +123456789012345678 +1 555 010 9999. é +33 1 23 45 67 89 x"),
    (5, None),
    (6, ""),
    (7, "漢字 a@b.cd 漢 1.1.1.1 é"),
    (8, "9" * 30000 + " " + "a" * 30000 + " " + "1." * 20000 + "@" * 50),
    (None, "x@y.zz"),
    (9, "x@y.zz"),
    (9, "x@y.zz"),
]


def test_base_hits_equal_plain_patterns(spark, corpus):
    docs = PII + [r[:2] for r in corpus]
    got = disclosure.report(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(brute.private(docs), key=repr)


def test_random_texts_equal_plain_patterns(spark):
    pick = random.Random(6)
    docs = [(k, "".join(pick.choice("0123456789 .-+()@a_%é") for _ in range(pick.randint(0, 120)))) for k in range(1500)]
    got = disclosure.report(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(brute.private(docs), key=repr)


def test_terms_that_tell_an_entity_are_found_and_removed(spark):
    filler = "the of and to in that with for from this"
    docs = [(k, f"{filler} {k} write to Zorblax, at zz@example.org about it {filler}") for k in range(4)]
    docs += [(10 + k, f"{filler} about {k} others the about") for k in range(120)] + [(160, f"{filler} one@example.org {filler}")]
    got = {r["doc_id"]: r["spans"] for r in disclosure.report(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = docs[0][1]
    a, b = text.index("Zorblax,"), text.index("zz@")
    assert f"term:{a}:{a + 8}" in got[0].split(",") and got[0].startswith(f"email:{b}:{b + 14}")
    assert not any(s.startswith("term") for k in (10, 160) for s in got[k].split(","))
    frame = spark.createDataFrame([(k, t, k) for k, t in docs], "doc_id long, text string, rid long")
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(spark, frame.drop("rid")).collect()}
    assert "Zorblax" not in clean[0] and "[email]" in clean[0] and clean[10] == docs[4][1]
    assert disclosure.report(spark, frame.limit(0)).count() == 0


def test_terms_are_found_for_entities_in_one_or_two_documents(spark):
    filler = "the of and to in that with for from this " * 10
    docs = [(0, f"Quuxley {filler} +49 30 1234567 {filler}"), (1, f"Vexmoor, {filler} 10.1.2.3 {filler}"), (2, f"{filler} 10.1.2.3 {filler} vexmoor")]
    docs += [(3, f"{filler} a@zorb.example {filler} (Zorblax)"), (4, f"zorblax {filler} b@ZORB.example {filler}")]
    docs += [(10 + k, f"{filler} other{k % 50}") for k in range(150)]
    got = {r["doc_id"]: r for r in disclosure.report(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, word in enumerate(["Quuxley", "Vexmoor,", "vexmoor", "(Zorblax)", "zorblax"]):
        at = docs[k][1].index(word)
        assert [s for s in got[k]["spans"].split(",") if s.startswith("term")] == [f"term:{at}:{at + len(word)}"]
    assert not any(got[d]["n_term"] for d, _ in docs[5:])


def test_terms_stand_for_their_entity_in_any_document(spark):
    filler = "the of and to in that with for from this " * 5
    docs = [(k, f"Zorblatt at zorb@mail.com {filler} zorblatt left") for k in range(5)] + [(5, f"{filler} Zorblatt, came 77 x")]
    docs += [(10 + k, f"{filler} others{k % 40}") for k in range(160)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in disclosure.report(spark, frame).collect()}
    at = docs[5][1].index("Zorblatt,")
    assert got[5] == [f"term:{at}:{at + 9}"] and sum(s.startswith("term") for s in got[0]) == 2 + 1  # left stands in no other document
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(spark, frame).collect()}
    assert clean[5] == f"{filler} [name] came 77 x" and clean[0] == f"[name] at [email] {filler} [word] "
    assert clean[10] == docs[6][1]


def test_terms_equal_brute_force(spark):
    pick = random.Random(12)
    names = [f"name{k}" for k in range(30)]
    hits = [f"u{k}@d{k % 3}.org" for k in range(6)] + ["10.0.0.1", "10.0.0.2", "+49 30 1234567", "4111 1111 1111 1111"]
    docs = []
    for k in range(400):
        words = [pick.choice(["the", "of", "and", "a,", "(an)"]) for _ in range(12)] + pick.sample(names, pick.randint(0, 2))
        if pick.random() < 0.15:
            h = pick.randrange(len(hits))
            words += [hits[h], f"Near{h}." if pick.random() < 0.8 else "", f"near{h}é!", names[h]]
        elif pick.random() < 0.04:
            words.append(f"near{pick.randrange(10)}")
        pick.shuffle(words)
        docs.append((k % 390 if k % 50 else None, " ".join(words) if k % 60 else None))
    got = disclosure.report(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute.disclosed(docs)
    assert sum(len(s) for _, s in want) > 50
    terms = [(r["doc_id"], [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")]) for r in got]
    assert sorted(terms, key=repr) == sorted(want, key=repr)


# mixing


def mixed_by_hand(corpus):
    sizes = {}
    for _, text, _, source in corpus:
        sizes[source] = sizes.get(source, 0) + len(brute.spaced(text))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if level * weights[s] > 3 * sizes[s]]
        if not over:
            return {s: (sizes[s], 3.0 * sizes[s] if s in full else level * weights[s]) for s in names}
        full |= set(over)


@pytest.mark.parametrize("slices", [50_000, 7])
def test_mix_meets_targets(spark, corpus, documents, slices, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", slices)
    got = mixing.mix(spark, documents).collect()
    want = mixed_by_hand(corpus)
    source = {k: s for k, _, _, s in corpus}
    text = {k: t for k, t, _, _ in corpus}
    taken = {}
    assert len(got) == len(corpus)
    for r in got:
        size, target = want[source[r["doc_id"]]]
        assert r["size"] == len(brute.spaced(text[r["doc_id"]])) and r["source_size"] == size and r["target"] == pytest.approx(target)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
    assert taken == {s: math.floor(t + 1e-9) for s, (_, t) in want.items()}
    monkeypatch.setattr(mixing, "SLICE", 50_000)
    assert rows(mixing.mix(spark, documents.repartition(2)), "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=repr)


def test_mix_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, None, None), (2, None, "z"), (3, "b", "")], "doc_id long, source string, text string")
    got = rows(mixing.mix(spark, docs), "doc_id", "size", "source_size", "taken")
    assert len(got) == 5 and sum(r[3] for r in got) <= 5
    assert mixing.mix(spark, docs.limit(0)).count() == 0
    assert rows(mixing.mix(spark, docs.filter("doc_id = 3")), "target", "taken") == [(0.0, 0)]


def test_rows_of_one_id_have_takings_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a", "x y z v", 7), (1, "a", "x", 8), (2, "a", "x y z", 9), (None, "a", "w", 1), (None, "a", "w", 1)], "doc_id long, source string, text string, taken int")
    assert rows(mixing.mix(spark, docs).groupBy().agg(F.sum("taken").alias("n")), "n") == [(10,)]
    got = mixing.mixed(spark, docs)
    assert got.columns == [*docs.columns, "_taken"] and got.select(F.sum("_taken")).first()[0] == 10
    assert rows(got, "doc_id", "text", "taken", "_taken") == sorted([(1, "x y z v", 7, 4), (1, "x", 8, 1), (2, "x y z", 9, 3), (None, "w", 1, 1), (None, "w", 1, 1)], key=repr)


def test_weights_of_nothing_put_rows_last(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], "w " * (3 if k % 2 else 9), [1.0, None, 0.0, -1.0, float("nan")][k // 2 % 5]) for k in range(200)], "doc_id long, source string, text string, w double")
    got = mixing.mix(spark, docs, weight=F.col("w")).join(docs.select("doc_id", "w"), "doc_id")
    assert got.count() == 200 and got.select(F.sum("taken")).first()[0] == 1200
    took = {r["doc_id"]: (r["taken"], r["size"], r["w"]) for r in got.collect()}  # source a has 900 words and a target of 400
    assert all(took[k][0] == 9 for k in range(0, 200, 10)) and sum(took[k][0] for k in range(0, 200, 2)) == 400


def test_slices_are_even_whatever_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 500)
    docs = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.lit("one two").alias("text"))
    seen = []
    plain = mixing.scratch
    monkeypatch.setattr(mixing, "scratch", lambda spark, df, name: seen.append((name, out := plain(spark, df, name))) or out)
    got = mixing.mix(spark, docs, weight=F.lit(0.05))
    assert got.select(F.sum("taken")).first()[0] == 40_000
    most = dict(seen)["slices"].groupBy("slice").count().agg(F.max("count")).first()[0]
    assert most < 1500


def test_weights_matter(spark):
    docs = spark.createDataFrame([(k, "a" if k % 2 else "b", "w " * 10 + ("!" * 400 if k % 4 < 2 else "")) for k in range(800)], "doc_id long, source string, text string")
    part = mixing.mix(spark, docs).join(docs.select("doc_id", "source", F.contains("text", F.lit("!")).alias("poor")), "doc_id").filter("source = 'a'")
    took = {r["poor"]: r["n"] for r in part.groupBy("poor").agg(F.sum("taken").alias("n")).collect()}
    assert took[False] >= 1900 and took[False] + took[True] == 2800  # of 2000 words of clean documents and 2200 of poor ones


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies to make this site better for you.</div>
<article><h1>A title &amp; more</h1><p>First paragraph,\n  with <b>bold</b>&nbsp;text.<p>Ok.<!-- <p>hidden</p> --><div class="ad">Buy this now, it is really very good.</div>
<blockquote>Quoted &lt;tag&gt; text&#33;</blockquote><ul><li>one</li><li>two</li></ul><p>1 < 2 and a<br>b</p></article>
<aside>Related: something else that is long enough to be text.</aside><section id="comments"><p>Great post, I liked every word of it.</p></section>
<form><p>Subscribe to us</p><textarea>in it</textarea></form><footer>&copy; me</footer></body></html>"""


def test_main_text():
    want = ["A title & more", "First paragraph, with bold\xa0text.", "Ok.", "Quoted <tag> text!", "one", "two", "1 < 2 and a b"]
    assert html_text.main_text(PAGE).split("\n") == want
    assert html_text.main_text(PAGE[: PAGE.index("</article>")]).split("\n") == want
    assert html_text.main_text("<p>Only a plain paragraph of text, as it were.</p><p>And one more of them.</p>").count("\n") == 1
    for empty in ("", "<", "<!-- x", "<p></p>", "<script>x", "</", "<a"):
        assert html_text.main_text(empty) == ""


def test_the_cut_is_a_minimum():
    pick = random.Random(1)
    for _ in range(60):
        n = pick.randint(1, 7)
        odds = [pick.choice([-3, -1, -0.5, 0.5, 1, 2.5]) + pick.random() / 10 for _ in range(n)]
        edges = {(a, b): pick.random() * 2 for a in range(n) for b in range(a + 1, n) if pick.random() < 0.5}

        def cost(side, odds=odds, edges=edges):
            return sum(max(x, 0) for x, s in zip(odds, side, strict=True) if not s) + sum(max(-x, 0) for x, s in zip(odds, side, strict=True) if s) + sum(c for (a, b), c in edges.items() if side[a] != side[b])

        best = min(cost([bool(k >> j & 1) for j in range(n)]) for k in range(2**n))
        assert cost(html_text.minimum_cut(odds, edges)) == pytest.approx(best)


def test_whole_pages_take_the_cheapest_labelling():
    pick = random.Random(3)
    parts = ["<p>A whole sentence of words, as it were.</p>", "<p>Ok</p>", "<p><a href=x>Menu entry</a></p>", "<h2>Some title</h2>", "<ul><li>one</li></ul>", "<p class=ad>Buy it.</p>", "<p>© 12|3</p>"]
    moved = 0
    for _ in range(60):
        page = "<article>" * pick.randint(0, 1) + "".join(pick.choice(parts) for _ in range(pick.randint(1, 5)))
        found = html_text.blocks_of(page)
        html_text.classify(found, html_text.PLAIN)
        odds, edges = html_text.graph_of(found)
        n = len(odds)

        def cost(side, odds=odds, edges=edges):
            return sum(abs(x) for x, s in zip(odds, side, strict=True) if (x > 0) != s and x) + sum(c for (a, b), c in edges.items() if side[a] != side[b])

        best = min(cost([bool(k >> j & 1) for j in range(n)]) for k in range(2**n))
        side = html_text.minimum_cut(odds, edges)
        assert cost(side) == pytest.approx(best)
        assert html_text.main_text(page).split("\n") == ([b.text for b, s in zip(found, side, strict=False) if s] or [""])
        moved += sum((b.odds > 0) != s for b, s in zip(found, side, strict=False))
    assert moved > 10  # the cut, not the sign of the odds, decides


def test_the_cut_labels_by_the_neighbours():
    long = "<p>A paragraph of the article, which has a good many words in it.</p>"
    assert html_text.main_text(f"<article>{long}<p>No</p>{long}</article>").count("\n") == 2
    assert html_text.main_text("<article>" + long + "<p>No</p>" * 40 + "</article>").count("\n") == 40
    assert "No" not in html_text.main_text(f"<body>{long}<nav><p>No</p></nav>{long}<div><p>No</p><p>No</p></div></body>")


def test_unclosed_tags_lose_nothing():
    rest = "<p>The rest of the page is text, as it was before.</p>"
    for tag in ("svg", "object", "audio", "video", "canvas", "template"):
        assert html_text.main_text(f"<{tag}>{rest}") == html_text.main_text(rest) != ""
        assert html_text.main_text(f"{rest}<{tag}><p>This is not text of the page, it is a fallback.</p></{tag}>") == html_text.main_text(rest)
    assert html_text.main_text("<p>So we have <math><mi>x</mi> = <mn>2</mn></math> and the proof ends.</p>") == "So we have x = 2 and the proof ends."
    assert html_text.main_text(f"{rest}<script>{rest}") == html_text.main_text(rest)
    for page in ("<div>" * 20_000 + rest, "<li><div>x" * 5_000, "<div>" * 5_000 + "</p></li>" * 5_000 + rest):
        html_text.main_text(page)


def test_weights_come_from_the_table(spark):
    page = "<nav><ul>" + "<li><a href=x>Some entry</a></li>" * 5 + "</ul></nav><article>" + "<p>These are words of an article, and more of them.</p>" * 5 + "</article>"
    pages = spark.createDataFrame([(k, page) for k in range(30)] + [(None, None)], "page_id long, html string")
    learned = html_text.train(spark, pages)
    assert learned[2] < 0 < learned[1] and np.allclose(learned, html_text.train(spark, pages.repartition(3)))
    assert tuple(html_text.train(spark, pages.limit(0))) == html_text.PLAIN == tuple(html_text.train(spark, pages.filter("page_id IS NULL")))


def test_pages_of_a_table(spark):
    pages = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "u", "<article>" + "<p>word and word.</p>" * 3000), (3, "u", "x")]
    got = rows(html_text.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id", "url", "n_chars", "text")
    assert len(got) == 5 and all(n == len(t) for *_, n, t in got)
    assert (3, "u", 3000 * 15 - 1, "\n".join(["word and word."] * 3000)) in got
