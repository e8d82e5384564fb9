import hashlib
import math
import random
import re

from attempt_grid.llm.pii import (
    KINDS,
    MAX_TOKENS,
    SPELLED,
    TOKEN,
    SemiMarkovField,
    all_spans,
    base_spans,
    find_personal_data,
    luhn,
    mask_personal_data,
    stretches,
    train_field,
)

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_force(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }
            if fits[kind]():
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    draw = random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choice("a1.2@+- ()9é\n,%_4") for _ in range(draw.randint(0, 60)))
        assert base_spans(text) == brute_force(text)
    for text in ["1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "a@b.c@d.e.f", "@@a@b.c", "0001.2.3.4", "+1 (017) 555-7713", "+123456789-"]:
        assert base_spans(text) == brute_force(text)
    assert base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]
    assert base_spans("9" * 200_000) == [] and base_spans("a" * 200_000 + "@b.cd")[0][1] == 0


def corpus(spark):
    draw, rows = random.Random(2), []
    for i in range(300):
        words = [draw.choice(["some", "plain", "words", "of", "text", "call", "it"]) for _ in range(30)]
        number = "".join(draw.choice("0123456789") for _ in range(15))
        words[5] = ["jo.%d@mail%d.example.com" % (i, i % 7), "10.%d.3.%d" % (i % 250, i % 99), "+1 (%03d) 555-%04d" % (i % 900, i * 7),
                    number + str(next(d for d in range(10) if luhn(number + str(d)))), "7" * 16][i % 5]
        words[20] = ["in 2024", "3.5", "12", "deadbeef01", "v1.2.3"][draw.randint(0, 4)]
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_field_adds_respelled_data_and_leaves_plain_text(spark, docs, texts):
    field = train_field(corpus(spark))
    assert [k for k, _, _ in all_spans("please call (389) 555-5010 today", field)[1]] == ["phone"]
    for text in ["in 2024 there were 12 of 3.5", "chapter 4, verse 12", "version 1.2.3 deadbeef01", "12:30 on 2024-01-02"]:
        assert all_spans(text, field)[1] == []
    for r in find_personal_data(docs, field).collect():
        base = brute_force(texts[r.doc_id] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]


def test_masking_and_odd_tables(spark, docs, no_docs, clashing, broken, texts):
    field = train_field(corpus(spark))
    masked = mask_personal_data(corpus(spark), field).collect()
    assert not any(base_spans(r.text) for r in masked)
    assert sum(r.text.count("<EMAIL>") for r in masked) == 60
    kept = mask_personal_data(docs, field)
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()} == texts
    assert find_personal_data(no_docs, train_field(no_docs)).collect() == []
    assert find_personal_data(clashing, field).count() == len(texts)
    assert find_personal_data(broken, field).count() == broken.count()


def test_addresses_in_words_far_from_digits(spark):
    field = train_field(corpus(spark))
    address = ["jo at mail dot example dot com", "jo at mail.example.com", "jo [at] mail [dot] example [dot] com", "jo.smith (at) example (dot) org"]
    for text in address:
        whole = f"{'plain words ' * 9}please write to {text} {'about it ' * 9}"
        assert [(k, whole[a:b]) for k, a, b in all_spans(whole, field)[1]] == [("email", text)]
    for text in ["we met at noon. Then we left", "look at the dot on the wall", "she arrived at home dot dot dot", "at", "at dot"]:
        assert all_spans(text, field) == ([], [])
    docs = spark.createDataFrame([(1, f"write to {address[0]} soon")], "doc_id long, text string")
    assert mask_personal_data(docs, field).first().text == "write to <EMAIL> soon"


def test_sums_over_segmentations():
    """Posteriors and the best segmentation against all segmentations of a few tokens."""
    draw = random.Random(3)
    for _ in range(40):
        n = draw.randint(1, 5)
        segments = [(i, j, [f"f{draw.randint(0, 4)}", f"g{j - i}"]) for i in range(n) for j in range(i + 1, n + 1) if draw.random() < 0.7]
        field = SemiMarkovField({f"{c}{k}": [draw.uniform(-2, 2) for _ in KINDS] for c in "fg" for k in range(6)})
        score = lambda k, kind: sum(field.weights[f][kind] for f in segments[k][2])

        def every(at):
            if at == n:
                yield ()
                return
            yield from every(at + 1)
            for k, (i, j, _) in enumerate(segments):
                if i == at:
                    for rest in every(j):
                        yield from (((k, kind), *rest) for kind in range(len(KINDS)))

        ways = [(math.exp(sum(score(*s) for s in way)), way) for way in every(0)]
        total = sum(w for w, _ in ways)
        if segments:
            found = field.marginals(n, segments)
            for k in range(len(segments)):
                for kind in range(len(KINDS)):
                    assert abs(found[k, kind] - sum(w for w, way in ways if (k, kind) in way) / total) < 1e-9
        assert [(k, kind) for k, kind, _ in field.best(n, segments)] == list(max(ways)[1])


def test_long_names_and_hosts(spark):
    """A span is looked at whole, however many characters its tokens have."""
    field = train_field(corpus(spark))
    for text in [
        "jo.smith at department-of-computer-science.example.com",
        "smith at department-of-computer-science.university.example.org",
        "bartholomew.featherstonehaugh-cholmondeley at mail dot example dot com",
        "bartholomew.featherstonehaugh.cholmondeley@department-of-computer-science.example.com",
    ]:
        whole = f"{'plain words ' * 9}please write to {text} {'about it ' * 9}"
        assert [(k, whole[a:b]) for k, a, b in all_spans(whole, field)[1]] == [("email", text)]


def test_addresses_lie_whole_in_a_stretch():
    """Dotted runs of up to MAX_TOKENS tokens around a trigger, whatever their length; linear work."""
    draw = random.Random(8)
    for _ in range(300):
        name = [draw.choice("ab") * draw.randint(1, 60) for _ in range(draw.randint(2, 7))]
        dot = draw.choice([".", " dot ", " [dot] "])
        k = draw.randrange(1, len(name))
        address = dot.join(name[:k]) + draw.choice(["@", " at "]) + dot.join(name[k:])
        text = f"{'plain words ' * 9}{address} {'about it ' * 9}"
        if len(TOKEN.findall(address)) <= MAX_TOKENS and SPELLED.search(address):
            assert any(a <= 108 and 108 + len(address) <= b for a, b in stretches(text))
    field = SemiMarkovField()
    for text in ["1 " * 20_000, "a@b.cd " * 20_000, ("x" * 5000 + " 7 ") * 100]:
        base, every = all_spans(text, field)
        assert len(every) >= len(base)
