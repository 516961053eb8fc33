import hashlib
import random
import re

from wavecairn.llm import common, pii
from wavecairn.llm.queries import op9_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in digits(m[0])][::-1]
        if 14 <= len(d) <= 19 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_rules_match_brute_force_on_random_texts():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "7", "45", "@", ".", "-", "+1", " ", "(", ")", "x.y", "%", "é", "b@c.d", "1.2.3.4", "4485275742308327", "+49 30 1234567"]) for _ in range(rng.randrange(30)))
        assert pii.joined(pii.base(text)) == brute(text), text


def test_query_against_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in op9_pii(spark, sf_dir).collect()}
    for d in common.documents(spark, sf_dir).collect():
        want = brute(d.text or "")
        assert got[d.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[d.doc_id].n_spans == len(list(filter(None, got[d.doc_id].spans.split(","))))
        assert set(filter(None, want.split(","))) <= set(got[d.doc_id].spans.split(","))


def test_trees_add_secrets_and_leave_plain_text():
    text = 'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and tel (555) 123-4567, order 1234 567 890'
    kinds = [k for _, _, k in pii.spans(text)[1]]
    assert kinds == ["secret", "local_phone"]
    assert pii.redact(text, pii.spans(text)[1]).startswith('the token = "[SECRET]" and tel [LOCAL_PHONE],')
    assert pii.spans("Plain prose without anything, at home dot point. " * 50)[1] == []
    x, y, _ = pii._examples(1500, 99)
    trained = pii.model()
    margin = trained["a"] * sum(pii._value(t, x) for t in trained["trees"]) + trained["b"]
    assert ((margin > 0) == y).mean() > 0.97


def test_long_texts_take_linear_time_and_odd_rows(spark):
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 200_000, "+1" * 100_000, "a@" * 100_000, "a-" * 200_000 + "1"):
        pii.spans(t)
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "me@x.org", 1), (3, "me@x.org", 2), (3, "me@x.org", 2)], "doc_id long, text string, n_chars int")
    got = sorted((r.n_email, r.spans, r.redacted) for r in pii.scan(docs).collect() if r.redacted)
    assert got == [(1, "email:0:8", "[EMAIL]")] * 3
    assert sorted((r.n_chars, r.text) for r in pii.redacted(docs).collect() if r.text) == [(7, "[EMAIL]")] * 3
    assert pii.scan(docs.limit(0)).count() == 0


def test_candidates_do_not_depend_on_the_rest_of_the_text():
    for text in ('password = "qWertZuioPasdFghjK"', "key = " + "aB3" * 200, "mail jo at host[DOT]org", "mail jo at host (DOT) org", "fe:ab:cd:ef:aa:bb:cc:dd"):
        own = pii.candidates(text)
        assert len(own) == 1 and pii.candidates(text + " on 7 dot days") == own, text


def test_many_spans_do_not_overlap_and_base_spans_stay():
    rng = random.Random(2)
    one = lambda: rng.choice(['token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', "tel (555) 123-4567", "me@host.org", "10.0.0.1", "4485275742308327", "ssn 123-45-6789"])
    text = " and ".join(one() for _ in range(5000))
    fixed, found = pii.spans(text)
    assert set(fixed) <= set(found) and len(found) > len(fixed) + 1000
    added = [s for s in found if s not in set(fixed)]
    ranges = sorted([*added, *[(*r, "base") for r in pii.covered(fixed)]])
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
