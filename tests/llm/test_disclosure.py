"""Which terms disclose a value, and where they go."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import pii


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def terms(df):
    """Each text to its disclosing terms."""
    body = {r.doc_id: r.text for r in df.collect()}
    out = {}
    for r in pii.scan_pii(df).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        out[body[r.doc_id]] = sorted(body[r.doc_id][int(a) : int(b)] for k, a, b in spans if k == "term")
    return out


@pytest.mark.parametrize("copied", [0, 250])
def test_copies_change_no_decision(spark, copied):
    """Copies of a text with the value, and of one without."""
    texts = [f"n{i} by zorblat to zo@mail.example about t{i} and rain" for i in range(4)] + [f"n{i} by someone about t{i} and rain" for i in range(4, 400)]
    plain, more = frame(spark, texts), frame(spark, texts + [texts[copied]] * 1000)
    want = terms(plain)
    assert all("zorblat" in want[t] for t in texts[:4])
    assert terms(more) == want
    clean = lambda df: {r.text for r in pii.sanitise(df).collect()}
    assert clean(more) == clean(plain)


def test_terms_go_wherever_they_stand(spark):
    """A name far from the value it discloses, in the title and beside it, and in a text without the value."""
    far = lambda i: " ".join(f"far{i}x{k}" for k in range(40))
    texts = [f"Zorblat report {i} {far(i)} zo@mail.example {far(i)} ends with zorblat" for i in range(5)]
    texts += [f"beside zo@mail.example zorblat, {far(5)} and zorblat zorblat", "one about zorblat"]
    other = [f"report {i} ends with rain" for i in range(400)]
    df = frame(spark, texts + other)
    got = terms(df)
    assert all(got[t].count("zorblat") + got[t].count("Zorblat") == t.lower().count("zorblat") for t in texts)
    assert not any(got[t] for t in other)
    clean = [r.text for r in pii.sanitise(df).sort("doc_id").collect()]
    assert not any("zorblat" in t.lower() for t in clean[: len(texts)]) and clean[len(texts) :] == other


def plain_words(text):
    """Words and where they stand, those that a protected value covers marked."""
    _, spans = pii.base_spans(text.encode())
    inside = {i for _, a, b in spans for i in range(a, b)}
    return [(m[0].translate({c: c + 32 for c in range(65, 91)}), m.start(), m.end(), bool(inside & set(range(m.start(), m.end())))) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def brute(texts):
    """((text or None for all, disclosing term) to action, term to wider term), by counting over all distinct texts."""
    texts = sorted(set(texts))
    n, every = len(texts), [{w for w, *_ in plain_words(t)} for t in texts]
    free = [{w for w, _, _, inside in plain_words(t) if not inside} for t in texts]
    found = [{(k, t[a:b].lower()) for k, a, b in pii.base_spans(t.encode())[1]} for t in texts]
    values = [{("value", k, v) for k, v in f} | {("wide", k, v.split("@")[1] if k == 0 else ".".join(v.split(".")[:2]) if k == 1 else re.sub("[^0-9]", "", v)[: 6 if k == 2 else 4]) for k, v in f} for f in found]
    df = Counter(w for ws in every for w in ws)
    action = {}
    for value in set().union(*values):
        holds = [i for i in range(n) if value in values[i]]
        ic = math.log2(n / len(holds))
        if value[0] == "wide" and len(holds) > pii.WIDEST * n:
            continue
        name = set(re.findall("[0-9a-z\x80-\U0010ffff]{4,}", value[2].split("@")[0])) if value[:2] == ("value", 0) else set()
        for w, co in Counter(w for i in holds for w in free[i]).items():
            if ic > 0:
                share = math.log2(co / len(holds) * n / df[w]) / ic * co / (co + 1) * min(len(holds), df[w]) / (min(len(holds), df[w]) + 1)
                share = max(share, math.log2(n / df[w]) / ic) if w in name and not w.isdigit() else share
                if share >= pii.GENERALISE - 1e-9:
                    for t in [texts[i] for i in holds] + [None] * (co > pii.EVERYWHERE * df[w]):
                        action[t, w] = max(action.get((t, w), ""), "remove" if share >= pii.REMOVE - 1e-9 else "generalise")
    wider, terms = {}, {w for _, w in action}
    what = lambda t, w: max(action.get((t, w), ""), action.get((None, w), ""))
    for w in terms:
        own = [ws for t, ws in zip(texts, free, strict=True) if w in ws and what(t, w) == "generalise"]
        options = [(df[x], x) for x, co in Counter(x for ws in own for x in ws).items() if x != w and x not in terms and co >= pii.WIDER_SHARE * len(own) and df[x] >= pii.WIDER_TIMES * len(own)]
        wider[w] = min(options)[1] if options and len(own) >= pii.WIDER_TEXTS else "[TERM]"
    return what, wider


def test_against_brute_force(spark):
    """Random texts over few words, some with values; terms, their spans and the sanitised texts."""
    r = random.Random(4)
    groups = [("alder", "tree"), ("birch", "tree"), ("cod", "fish"), ("dab", "fish")]
    texts = []
    for i in range(400):
        kind, wide = r.choice(groups)
        words = [r.choice(["rain", "sun", "wind", "snow", f"t{i}", wide.title()]) for _ in range(r.randrange(3, 9))] + [wide]
        if r.random() < 0.35:
            words.append(kind)
        if r.random() < (0.5 if kind in words and kind in ("alder", "cod") else 0.05):
            words.append(f"{kind}@mail.example")
        r.shuffle(words)
        texts.append(" ".join(words))
    texts += [f"odd{k} zeta-{k} zeta@mail.example" for k in range(5)] + texts[:20] + ["", "no words: !!"]
    texts += ["rain by marlowe, see Marlowe.77@far.example and 10.20.30.40", "marlowe sun 10.20.1.1 snow", "sun of rain.77@near.example +49 (221) 555-0101", *[f"gannet wind{k} g{k}@{'close' if k < 4 else 'near'}.example" for k in range(6)]]
    what, wider = brute(texts)
    assert {"remove", "generalise", ""} <= {what(t, w) for t in texts for w, *_ in plain_words(t)} and any(v != "[TERM]" for v in wider.values())
    df = frame(spark, texts)
    clean = {k.doc_id: k.text for k in pii.sanitise(df).collect()}
    for k in pii.scan_pii(df).collect():
        text = texts[k.doc_id]
        spans = [(a, b, w) for w, a, b, inside in plain_words(text) if not inside and what(text, w)]
        new = lambda w: "" if what(texts[k.doc_id], w) == "remove" else wider[w]  # noqa: B023, E731
        assert [s for s in k.spans.split(",") if s.startswith("term")] == [f"term:{a}:{b}" for a, b, _ in spans]
        both = sorted([(a, b, new(w)) for a, b, w in spans] + [(a, b, f"[{pii.KINDS[x].upper()}]") for x, a, b in pii.base_spans(text.encode())[1]], reverse=True)
        for a, b, put in both:
            text = text[:a] + put + text[b:]
        assert clean[k.doc_id] == text


def test_names_and_wider_forms(spark):
    """A name in an address stands in the text too; a word comes only with addresses of one small domain; common words stay."""
    texts = ["minutes kept by Oferones: write to oferones.34@mail7.example, rain", "someone of rain and rain.12@mail7.example says", "wind 1 for a@guild.example of zorbla", "wind 2 for b@guild.example of zorbla", "wind 3 for c@guild.example of zorbla", "wind 4 for d@guild.example of zorbla"]
    texts += [f"report {i} of rain and wind for all that someone says" for i in range(900)]
    got = terms(frame(spark, texts))
    assert got[texts[0]] == ["Oferones"] and got[texts[1]] == [] and all(got[t] == ["zorbla"] for t in texts[2:6]) and not any(got[t] for t in texts[6:])


def test_many_pairs_in_one_text(spark, monkeypatch):
    """Counts of pairs that are handed on in parts are those of one."""
    texts = [f"n{i} by zorblat {'blue' if i % 2 else 'green'} to zo@mail.example about rain and snow" for i in range(12)] + [f"n{i} about rain and snow by someone" for i in range(300)]
    before = sorted(map(str, pii.sanitise(frame(spark, texts)).collect()))
    monkeypatch.setattr(pii, "HELD_PAIRS", 3)
    assert sorted(map(str, pii.sanitise(frame(spark, texts)).collect())) == before
