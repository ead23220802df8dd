import hashlib
import random
import re
import string
import time

from xylem.llm import secrets

#: The named patterns as they are written down, before their lengths are checked.
BASE = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0, 18, 0), ("hex", r"[0-9a-f]+", 0, 16, 0))


def brute(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, pattern, group, least, flags) in enumerate(BASE) for m in re.finditer(pattern, text or "", flags) if len(m.group(group)) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


def texts():
    rng = random.Random(2)
    parts = ["password", "API_KEY", "apikey", "Token", "ſecret", "toKen", " = ", ":", '"', "'", "AKIA", "0123456789abcdef", "deadbeef", "é", "\U0001f600", " ", "\n", "ABCDEFGH12345678", "zz", "=", "."]
    return ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(1500)]


def test_named_patterns_match_brute_force(spark):
    rows = list(enumerate([*texts(), None, ""]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in secrets.digest(secrets.find_secrets(df)).collect():
        want = brute(rows[r.doc_id][1])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in want) for x in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in line.split(",") if s]


def test_random_strings_stand_out():
    encode = secrets.encoding(secrets.VOCABULARY).encode_ordinary
    rng = random.Random(4)
    noise = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=k)) for k in range(20, 120)]
    found = [secrets.random_spans(f"see {x} there", [], encode) for x in noise]
    assert sum(bool(f) for f in found) >= 97
    calm = ["internationalization", "https/www/example/com/index", "2024-01-01/2024-12-31", "550e8400-e29b-41d4-a716-446655440000", "d41d8cd98f00b204e9800998ecf8427e", hashlib.sha1(b"x").hexdigest(), hashlib.sha256(b"x").hexdigest(), "some_long_snake_case_name", "CamelCaseIdentifierName", "=" * 40, "1234567890123456789", "the-quick-brown-fox-jumps", "A" * 300]
    assert [x for x in calm if secrets.random_spans(f"see {x} there", [], encode)] == []
    text = "token = " + noise[0]
    assert secrets.random_spans(text, secrets.base_spans(text), encode) == []


def test_runs_of_any_length_are_judged():
    encode = secrets.encoding(secrets.VOCABULARY).encode_ordinary
    rng = random.Random(6)
    for k in (257, 300, 1600, 20_000):
        blob = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=k))
        (_, a, b), *more = secrets.random_spans(f"see {blob} there", [], encode)
        assert not more and b - a >= k - 2
    words = ["images", "summer", "catalog", "products", "archive", "network", "the-quick-brown-fox", "some_long_name"]
    for n in (4, 40, 400):
        path = "/".join(rng.choices(words, k=n))
        assert secrets.random_spans(path, [], encode) == []
        key = "".join(rng.choices(string.ascii_letters + string.digits, k=24))
        key = f"{key[:8]}7x{key[8:16]}4Q{key[16:]}"
        found = secrets.random_spans(f"{path}/{key}/{path}", [], encode)
        assert any(a <= len(path) + 1 and b >= len(path) + 29 for _, a, b in found)
        assert secrets.random_spans(f"{path}/{hashlib.sha1(b'x').hexdigest().upper()}/{path}/550e8400-e29b-41d4-a716-446655440000/{path}", [], encode) == []


def test_random_letters_stand_out():
    encode = secrets.encoding(secrets.VOCABULARY).encode_ordinary
    rng = random.Random(8)
    found = lambda x: secrets.random_spans(f"see {x} there", [], encode)
    assert found("kJhGfDsQwErTyUiOpLkMnB") == [("random", 4, 26)]
    for alphabet in (string.ascii_letters, string.ascii_letters + string.digits):
        for k in (16, 20, 24, 32):
            assert sum(bool(found("".join(rng.choices(alphabet, k=k)))) for _ in range(300)) >= 297
    calm = ["getElementsByTagNameNS", "MAX_RETRY_COUNT_LIMIT", "INTERNATIONALIZATION", "src/main/java/com/foo/Bar", "XMLHttpRequestEventTarget", "user_profile_settings_2024", "Donaudampfschifffahrtsgesellschaft"]
    assert [x for x in calm if found(x)] == []


def naive_random(text, encode):
    """Random spans by loops over characters: runs, their judgement whole or by pieces and windows, hits that overlap merged."""
    letters, digits = string.ascii_letters, string.digits
    plain = lambda x: all(c in letters + digits for c in x)
    is_hex = lambda x: bool(x) and all(c in "0123456789abcdefABCDEF" for c in x)
    uuid = lambda x: [len(p) for p in x.split("-")] == [8, 4, 4, 4, 12] and all(map(is_hex, x.split("-")))
    digest = lambda x: is_hex(x) and len(x) in (32, 40, 56, 64, 96, 128)

    def words(x):
        tail = 0
        while tail < 4 and tail < len(x) and x[len(x) - 1 - tail] in digits:
            tail += 1
        for cut in range(tail + 1):
            body = x[: len(x) - cut]
            if any(c in digits for c in body):
                continue
            parts, part = [], ""
            for c in body + "-":
                if c in "-_/=+":
                    parts, part = [*parts, part], ""
                else:
                    part += c
            one_case = lambda p: p[1:] == p[1:].lower() or p == p.upper()
            return all(len(p) < 16 and one_case(p) or len(p) >= secrets.CHARS_PER_TOKEN * len(encode(p)) for p in parts if p)
        return False

    def odd(x):
        if digest(x) or uuid(x) or not any(c in letters for c in x) or (not any(c in digits for c in x) and x[1:].islower()):
            return False
        return len(x) < secrets.CHARS_PER_TOKEN * len(encode(x)) and not words(x)

    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and (text[j] in letters + digits + "+/_=-"):
            j += 1
        a, b = i, j
        while a < b and text[a] in "=/+-_":
            a += 1
        while b > a and text[b - 1] in "=/+-_":
            b -= 1
        run, i = text[a:b], max(j, i + 1)
        if j - a < 16 or b - a < 16 or digest(run) or uuid(run) or not any(c in letters for c in run):
            continue
        if len(run) <= 256 and odd(run):
            out.append((a, b))
            continue
        known = [(p, q) for p in range(len(run)) for q in {p + n for n in (32, 36, 40, 56, 64, 96, 128)} if q <= len(run) and (digest(run[p:q]) or uuid(run[p:q])) and (p == 0 or not plain(run[p - 1])) and (q == len(run) or not plain(run[q]))]
        spans, p = [], 0
        while p < len(run):
            q = p
            while q < len(run) and plain(run[q]):
                q += 1
            spans, p = spans + [(p, q)] * (16 <= q - p <= 256), max(q, p + 1)
        if len(run) > 64:
            spans += [(k, k + 64) for k in sorted({*range(0, len(run) - 64, 32), len(run) - 64}) if not any(x < k + 64 and k < y for x, y in known)]
        covered = sorted((a + p, a + q) for p, q in spans if odd(run[p:q]))
        merged = []
        for p, q in covered:
            if merged and p < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(q, merged[-1][1]))
            else:
                merged.append((p, q))
        out += merged
    return [("random", a, b) for a, b in out]


def test_random_spans_against_brute_force():
    encode = secrets.encoding(secrets.VOCABULARY).encode_ordinary
    rng = random.Random(12)
    noise = lambda n, alphabet=string.ascii_letters + string.digits: "".join(rng.choices(alphabet, k=n))
    makers = [lambda: noise(rng.randrange(1, 40)), lambda: noise(rng.randrange(1, 30), string.ascii_letters), lambda: noise(rng.randrange(200, 400)), lambda: "internationalization", lambda: "getElementById", lambda: hashlib.md5(noise(3).encode()).hexdigest(), lambda: "550e8400-e29b-41d4-a716-446655440000", lambda: noise(rng.randrange(1, 30), string.digits)]
    for _ in range(600):
        text = "".join(rng.choice(makers)() + rng.choice([" ", "-", "_", "/", "=", "+", ".", "--", "é", ""]) for _ in range(rng.randrange(1, 9)))
        assert secrets.random_spans(text, [], encode) == naive_random(text, encode), text


def test_long_runs_of_joiners_take_no_time():
    encode = secrets.encoding(secrets.VOCABULARY).encode_ordinary
    for text in ["section" + "-" * n + "1a" for n in (20, 256, 10_000)] + ["foo" + "_" * n + "12345" for n in (24, 256, 10_000)] + ["a-" * 5000 + "9Z", "a=/+" * 2500 + "!", "x" * 10_000, "aB3" * 3334, "0" * 10_000 + "g"]:
        began = time.process_time()
        secrets.random_spans(text, secrets.base_spans(text), encode)
        assert time.process_time() - began < 0.1, text[:40]


def test_odd_rows(odd_docs, no_docs):
    out = secrets.find_secrets(odd_docs).collect()
    assert len(out) == 13 and not any(r.found for r in out) and secrets.find_secrets(no_docs).collect() == []
