"""Patterns against the plain expressions; the field's agreement across a document."""

import hashlib
import random
import re

import numpy as np

from vigilo.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def passes_luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text)
            if 13 <= len(digits(m.group())) <= 19 and passes_luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return [f"{k}:{a}:{b}" for k, a, b in out]


def test_patterns_on_random_texts():
    random.seed(2)
    parts = ["a", "1", "23", "456", ".", ".", "@", "-", "+", " ", "%", "(", ")", "\n", "4111", "é", "255", "0", "999",
             "4111 1111 1111 1111", "+1 (476) 555-3519", "a.b@c.de", "10.0.0.1", "٣"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randint(1, 25)))
        assert P.listed(P.base_spans(text)).split(",") == (plain_spans(text) or [""]), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 100_000, "@" * 100_000):
        P.base_spans(text)


def test_table(real_docs, odd_docs):
    for docs in (real_docs, odd_docs):
        texts = docs.select("doc_id", "text").collect()
        # The plain expressions take the square of a long run, so such texts are left to the test above.
        want = sorted((str(r.doc_id), hashlib.sha256(",".join(plain_spans(r.text or "")).encode()).hexdigest())
                      for r in texts if len(r.text or "") < 25_000)
        got = P.personal_data(docs, P.fit(docs)).collect()
        assert len(got) == len(texts)
        size = {str(r.doc_id): len(r.text or "") for r in texts}
        assert want == sorted((str(r.doc_id), r.base_sha256) for r in got if size[str(r.doc_id)] < 25_000)
        for r in got:
            spans = [s.split(":") for s in r.spans.split(",") if s]
            for kind in P.KINDS:
                own = [(int(a), int(b)) for k, a, b in spans if k == kind]
                assert own == sorted(own) and all(x[1] <= y[0] for x, y in zip(own, own[1:]))
                assert len(own) >= r[f"n_{kind}"]


def model_of(texts):
    return P.learn(texts, P.Settings())


def some_texts():
    rng = random.Random(1)
    word = lambda: rng.choice(["call", "the", "of", "and", "was", "mail", "seen", "at"])
    out = []
    for i in range(200):
        what = rng.choice([f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"u{i}@mail.example.com",
                           f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.3.4", f"room {rng.randint(1, 99)}", "in 1999"])
        out.append(" ".join([word() for _ in range(8)] + [what] + [word() for _ in range(8)]))
    return out


def test_repeats_without_their_marks_are_found():
    model = model_of(some_texts())
    text = "call +1 (476) 555-3519 now. Or else (476) 555-3519 again, in room 12."
    (base, every), = P.find([text], model, P.Settings())
    assert [text[a:b] for _, a, b in base] == ["+1 (476) 555-3519"]
    added = [text[a:b] for k, a, b in every if (k, a, b) not in base]
    assert added == ["(476) 555-3519"]
    # Without the first there is nothing to agree with.
    alone = "Or else (476) 555-3519 again, in room 12."
    assert P.find([alone], model, P.Settings())[0][0] == []


def test_plain_texts_get_no_spans():
    model = model_of(some_texts())
    for base, every in P.find(["seen in 1999 and 2001, room 12", "no digits", ""], model, P.Settings()):
        assert base == every == []


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    unary = rng.normal(size=(4, P.LABELS))
    edges = np.array([(0, 1), (1, 2), (1, 3)])
    pair = rng.normal(size=(3, P.LABELS, P.LABELS))
    joint = np.zeros((P.LABELS,) * 4)
    for x in np.ndindex(*joint.shape):
        joint[x] = np.exp(sum(unary[i, x[i]] for i in range(4)) + sum(pair[k, x[a], x[b]] for k, (a, b) in enumerate(edges)))
    joint /= joint.sum()
    want = np.stack([joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)])
    got = P.marginals(unary, edges, pair, P.Settings(rounds=60))
    assert np.allclose(got, want, atol=1e-6)


def test_redaction_keeps_columns_and_removes_spans(odd_docs, make_docs, no_docs):
    docs = make_docs(["mail a.b@c.de or 10.0.0.1", None, "", "plain"])
    got = {r.doc_id: r for r in P.redact(docs, P.fit(docs)).collect()}
    assert got[0].text == "mail [EMAIL] or [IP]" and got[0].n_chars == len(got[0].text)
    assert got[1].text is None and got[2].text == "" and got[3].text == "plain"
    odd = P.redact(odd_docs, None)
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count()
    assert P.redact(no_docs, P.fit(no_docs)).count() == 0
    assert P.personal_data(no_docs, None).count() == 0


def test_evidence_reaches_the_last_repeat():
    model = {"weights": np.zeros((P.FEATURES, P.LABELS)), "chain": np.zeros((P.LABELS, P.LABELS)), "skip": 9 * np.eye(P.LABELS)}
    text = "call +1 4765553519 now." + " see 4765553519 again." * 60
    (base, every), = P.find([text], model, P.Settings())
    assert len(base) == 1 and len(every) == 61


def test_messages_settle_at_the_settings_in_use():
    rng = np.random.default_rng(1)
    n = 80
    unary, pair = rng.normal(size=(n, P.LABELS)) / 4, rng.normal(size=(n - 1, P.LABELS, P.LABELS)) / 4 + 5 * np.eye(P.LABELS)
    unary[0] += 20 * np.eye(P.LABELS)[3]
    ahead, back = np.zeros((n, P.LABELS)), np.zeros((n, P.LABELS))
    for i in range(1, n):
        ahead[i] = np.logaddexp.reduce((ahead[i - 1] + unary[i - 1])[:, None] + pair[i - 1], axis=0)
        back[n - 1 - i] = np.logaddexp.reduce((back[n - i] + unary[n - i])[None] + pair[n - 1 - i], axis=1)
    want = np.exp(P.log_softmax(unary + ahead + back))
    edges = np.array([(i, i + 1) for i in range(n - 1)])
    assert np.allclose(P.marginals(unary, edges, pair, P.Settings()), want, atol=1e-4)
    # Odd loops of disagreement swing; they end all the same.
    loop = np.array([(i, j) for i in range(9) for j in range(i)])
    got = P.marginals(rng.normal(size=(9, P.LABELS)), loop, np.broadcast_to(-4 * np.eye(P.LABELS), (len(loop), P.LABELS, P.LABELS)), P.Settings())
    assert np.allclose(got.sum(axis=1), 1)
