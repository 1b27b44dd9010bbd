"""Personal data, secrets and contamination against plain patterns and loops."""

import hashlib
import random
import re

from folioscope.llm import decontam, pii, queries, secrets
from folioscope.llm.common import WORD, ascii_lower, words_of
from tests.llm.data import documents, empty, stored, texts

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(t):
    return [int(c) for c in t if c in "0123456789"]


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0


def plain_pii(t):
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15],
    }


def test_anchors_find_what_patterns_find():
    rng = random.Random(5)
    for k in range(30_000):
        t = "".join(rng.choice("ab1234567890000....@@++-- ()é%_\n") for _ in range(rng.randint(0, 40)))
        t = t.replace("a", "1").replace("b", ".") if k % 3 == 0 else t
        found = pii.find(t)
        assert {k: found[k] for k in pii.BASE_KINDS} == plain_pii(t), t


def test_added_kinds():
    t = "See https://example.org/a?b=1, IBAN: GB82WEST12345698765432 and GB82WEST12345698765433; SSN: 123-45-6789."
    found = pii.find(t)
    assert [t[a:b] for k in pii.ADDED_KINDS for a, b in found[k]] == ["https://example.org/a?b=1", "GB82WEST12345698765432", "123-45-6789"]


def test_pii_table(spark, tmp_path):
    docs = stored(documents(spark), tmp_path)
    rows = queries._digested(pii.pii_spans(docs, keep=["doc_id", "text"]).withColumnRenamed("text", "t"), pii.BASE_KINDS).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r.text for r in docs.collect()}
    for r in (r for r in rows if r.doc_id is not None):
        want = plain_pii(by_id[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, i, k, b) for i, k in enumerate(pii.BASE_KINDS) for a, b in want[k]))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in pii.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.pii_spans(empty(spark)).count() == 0


PLAIN_RULES = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain_secrets(t, kind):
    pattern, valid = PLAIN_RULES[kind]
    return [m.span() for m in pattern.finditer(t) if valid(m)]


def test_index_loses_nothing():
    scanner, rng = secrets.Scanner(secrets.RULES), random.Random(6)
    parts = ["pass", "word", "PASSWORD", "passwd", "Secret", "token", "api", "_", "key", "Key", "'", '"', ":", "=", " ", "abc", "1f", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef12", "é", "ſ", "K", "eyJa", ".", "ghp_", "-", "paſſword"]
    for _ in range(600):
        block = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20)]
        for t, found in zip(block, scanner.scan(block)):
            for rule, pattern in zip(scanner.rules, scanner.patterns):
                want = plain_secrets(t, rule.kind) if rule.kind in PLAIN_RULES else [m.span() for m in pattern.finditer(t)]
                assert found.get(rule.kind, []) == want, (rule.kind, t)


def test_queries_of_patterns():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", "aki", "kia")
    assert secrets.trigram_query("abc|xyz+") == ("or", "abc", "xyz")
    assert secrets.trigram_query("(?:abc)?") is True
    assert secrets.trigram_query("a.*b") is True
    assert secrets.trigram_query("abcd?e") == ("or", ("and", "abc", "bcd", "cde"), ("and", "abc", "bce"))


def test_secret_table(spark, tmp_path):
    docs = stored(documents(spark), tmp_path)
    by_id = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    rows = secrets.secret_spans(docs).collect()
    assert len(rows) == docs.count()
    for r in (r for r in rows if r.doc_id is not None):
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(plain_secrets(by_id[r.doc_id], k)) for k in PLAIN_RULES)
    assert secrets.secret_spans(empty(spark)).count() == 0


def plain_hits(words, items, window):
    flags, found = [0] * len(words), set()
    for i, item in items:
        n = min(window, len(item))
        for a in range(len(item) - n + 1 if n else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == item[a : a + n]:
                    found.add(i)
                    flags[b : b + n] = [1] * n
    return flags, found


def test_automaton_is_all_windows():
    rng = random.Random(3)
    for k in range(1500):
        window, letters = rng.choice([2, 3, 4]), [c.encode() for c in ("abc" if k % 2 else "ab")]
        items = [(j, [rng.choice(letters) for _ in range(rng.randint(0, 8))]) for j in range(rng.randint(0, 5))]
        automaton = decontam.SuffixAutomaton(items, window)
        for _ in range(4):
            words = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 20))]
            flags, found, _ = automaton.hits(words)
            assert (list(flags or [0] * len(words)), found) == plain_hits(words, items, window)


def test_words():
    for t in [*texts(), "aÄ\x1c b c\x85d 1_2"]:
        assert [w.decode() for w in words_of(t)] == re.findall(WORD, ascii_lower(t or ""))


def test_contamination_table(spark, tmp_path):
    bench = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (10, "short item"), (2, None), (3, ""), (4, "short item"), (None, "id less item")]
    hit = [(200, "x " * 300 + bench[0][1].upper() + " y" * 10, *[None] * 18), (201, "a SHORT, item!", *[None] * 18), (202, "z " * 500 + "id less item", *[None] * 18)]
    docs = stored(documents(spark, hit), tmp_path)
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    items = [(i, words_of(t)) for i, t in bench]
    for block_bytes in (1 << 20, 40):  # one automaton, and several blocks
        rows = decontam.decontaminate(docs, benchmark, clean=True, block_bytes=block_bytes).collect()
        assert len(rows) == docs.count()
        for r in rows:
            flags, found = plain_hits(words_of(r.text), items, 13)
            assert (r.n_words, r.n_hit, list(r.item_ids)) == (len(flags), sum(flags), sorted(i for i in found if i is not None))
            assert r.contaminated == (sum(flags) > 0 and 20 * sum(flags) >= len(flags))
            assert len(words_of(r.clean_text)) == len(flags) - sum(flags)
    assert decontam.decontaminate(docs, benchmark.filter("false")).filter("n_hit > 0").count() == 0
    assert decontam.decontaminate(empty(spark), benchmark).count() == 0
