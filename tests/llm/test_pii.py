import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from deltascape.llm.pii import entities, luhn, sanitise

from .helpers import documents, simple

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@given(st.text(alphabet="ab@.-_+%1234567890() \n", max_size=120))
def test_equals_the_patterns(text):
    assert entities(text) == brute(text)


@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "10.0.0.1", "999.1.1.1", "001.002.003.004", "a.b@c.de", "@", "x@y", "é", " ", "12", "1.2.3.4.5.6.7.8", "+"]), max_size=12))
def test_equals_the_patterns_on_likely_parts(parts):
    for glue in ("", " ", "-"):
        text = glue.join(parts)
        assert entities(text) == brute(text)


def test_long_runs_end():
    assert entities("1" * 200000 + "." + "a" * 200000 + "@" + "@a" * 1000) == []


def rows():
    out = [(i, f"some words come here then callback {'+1 555 010 ' + str(1000 + i)} and more words follow it number {i}", "a") for i in range(40)]
    return [*out, *[(100 + i, "some words come here and more words follow it", "a") for i in range(400)], (None, None, None), (600, "", "a"), (601, "mail me x.y@z.org now", "b"), (601, "mail me x.y@z.org now", "b")]


def test_revealing_terms_are_added_and_base_stays(spark):
    got = sanitise(documents(spark, rows())).collect()
    assert len(got) == len(rows())
    by_id = {r.doc_id: r for r in got}
    text = rows()[0][1]
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
    at = text.index("callback")
    assert by_id[0].n_phone == 1 and by_id[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert by_id[0].spans.startswith(base) and f"term:{at}:{at + 8}" in by_id[0].spans
    assert "555" not in by_id[0].text and "callback" not in by_id[0].text and "some words" in by_id[0].text
    assert by_id[100].spans == "" and by_id[100].text == rows()[40][1]
    assert by_id[None].spans == "" and by_id[600].text == ""
    assert by_id[601].n_email == 1 and by_id[601].text == "mail me <email> now"


def test_support_does_not_grow_with_the_corpus(spark, monkeypatch):
    """A term by four entities of some hundreds tells as it does in a small corpus."""
    from deltascape.llm import pii

    monkeypatch.setattr(pii, "RARE", 16, raising=False)  # where support followed the corpus, as if this one were large
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04}")
    few = [(i, f"plain words all around hotline +1 555 777 {1000 + i} and more plain words", "a") for i in range(4)]
    many = [(10 + i, f"{letters(i)} plain words all around here +1 555 010 {1000 + i} and more plain words", "a") for i in range(200)]
    plain = [(1000 + i, "here are plain words all around and more plain words " * 5, "a") for i in range(400)]
    docs = documents(spark, [*few, *many, *plain])
    texts = docs.select("text")
    terms = {r.term: (r.kind, r.shown) for r in pii.revealing_terms(texts, pii.char_bits(texts))[0].collect()}
    assert {t for t in terms if " " not in t} == {"hotline"} and terms["hotline"] == ("phone", 1.0)
    got = {r.doc_id: r for r in sanitise(docs).collect()}
    assert all("term:" in got[i].spans and "hotline" not in got[i].text for i in range(4))


def test_without_entities(spark):
    got = sanitise(simple(spark, ["no data", None])).collect()
    assert [r.spans for r in got] == ["", ""]
    assert sanitise(simple(spark, [])).count() == 0


def key(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


def test_secrets_by_information(spark):
    """Keys are found by their bits and reveal the word before them; long words, numbers and repeats are no secrets."""
    rng = random.Random(2)
    words = "river market stone house green moves today under along further".split()
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{plain(30)} passkey = {chr(34)}{key(i)}{chr(34)} {plain(30)}", "a") for i in range(30)]
    clean = ["47369625730995123456", "extraordinarilylongwordwithoutend", "a1" * 12, "chapter_12_of_the_long_report", "2020-01-02-2021-02-03", "GREENMARKETSTONEHOUSE2020"]
    rows += [(100 + i, f"{plain(20)} {clean[i % len(clean)]} {plain(20)}", "a") for i in range(300)]
    got = {r.doc_id: r for r in sanitise(documents(spark, rows)).collect()}
    for i, text, _ in rows[:30]:
        at, word = text.index(key(i)), text.index("passkey")
        assert got[i].spans.split(",") == [f"secret:{at}:{at + 40}", f"term:{word}:{word + 7}"] and got[i].n_added == 2
        assert key(i) not in got[i].text and "passkey" not in got[i].text
    assert all(got[i].spans == "" and got[i].text == t for i, t, _ in rows[30:])


def near_by_hand(text, spans):
    bare = list(text)
    for _, a, b in spans:
        bare[a:b] = "#" * (b - a)
    bare = "".join(bare)
    for kind, a, b in spans:
        for side in (re.findall(r"[^\W\d_]+", bare[:a].lower())[-5:], re.findall(r"[^\W\d_]+", bare[b:].lower())[:5]):
            for t in [*side, *(f"{v} {w}" for v, w in itertools.pairwise(side))]:
                yield kind, t, text[a:b]


def test_disclosure_equals_brute_force(spark):
    from deltascape.llm import pii

    rng = random.Random(5)
    words = [a + b for a in "ba de ki lo mu".split() for b in "na ro si tu".split()]
    texts = []
    for i in range(150):
        own = [rng.choice(words) for _ in range(25)]
        if i % 3 == 0:
            own[rng.randrange(25)] = rng.choice(["write to", "mail", "kiro"]) + f" u{i}@x.org"
        if i % 4 == 0:
            own[rng.randrange(25)] = f"kiro host 10.0.{i}.1"
        texts.append(" ".join(own))
    slots, near, entity, total, n_words = Counter(), Counter(), {}, Counter(), 0
    for text in texts:
        own = re.findall(r"[^\W\d_]+", text.lower())
        n_words += len(own)
        total.update([*own, *(f"{v} {w}" for v, w in itertools.pairwise(own))])
        for kind, term, value in near_by_hand(text, entities(text)):
            near[kind, term] += 1
            entity.setdefault((kind, term), set()).add(value)
            slots[kind] += " " not in term
    p = {k: n / n_words for k, n in slots.items()}
    shown = {kt: math.log(min(1, n / total[kt[1]]) / p[kt[0]]) / -math.log(p[kt[0]]) for kt, n in near.items() if len(entity[kt]) >= pii.SUPPORT}
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    terms, thresholds = pii.revealing_terms(frame, pii.char_bits(frame))
    assert set(thresholds) == {"email", "ip"}
    over = {}
    for (kind, term), v in shown.items():
        if v >= thresholds[kind] and v > over.get(term, ("", -1))[1]:
            over[term] = (kind, v)
    want = {t: o for t, o in over.items() if " " not in t or not set(t.split()) & {w for w in over if " " not in w}}
    got = {r.term: (r.kind, r.shown) for r in terms.collect()}
    assert {"write to" in got or "write" in got, "mail" in got, "host" in got} == {True}
    assert got.keys() == want.keys() and all(got[t][0] == want[t][0] and got[t][1] == pytest.approx(want[t][1]) for t in got)


def test_terms_in_several_passes(spark, monkeypatch):
    from deltascape.llm import pii

    more = [(700 + i, f"other words then ring hotline +1 555 020 {1000 + i} and others after it", "a") for i in range(30)]
    docs = documents(spark, [*rows(), *more])
    whole = sorted(map(str, sanitise(docs).collect()))
    assert sum("term:" in r for r in whole) >= 70
    monkeypatch.setattr(pii, "PASS_TERMS", 1)
    assert sorted(map(str, sanitise(docs).collect())) == whole


def test_very_long_texts(spark):
    text = "plain words and more " * 60000 + "u1@x.org " + "x" * 300000 + " 10.0.0.1"
    got = sanitise(simple(spark, [text]), with_text=True).collect()[0]
    assert (got.n_email, got.n_ip) == (1, 1) and got.text == text.replace("u1@x.org", "<email>").replace("10.0.0.1", "<ip>")
