import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lamina.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in (window.count(c) for c in set(window)))


def spans(text):
    """As the operator, but every window's entropy on its own."""
    blank = lambda m: " " * len(m[0])
    cut = re.sub(secrets._ASSIGNED, " ", text)
    cut = re.sub(r"[/_+-](?=[0-9a-fA-F]{20,}(?![A-Za-z0-9]))", " ", cut)
    cut = re.sub(r"(?<![A-Za-z0-9])([0-9a-fA-F]{20,}+)[/_+-]", r"\1 ", cut)
    cut = re.sub(secrets.PLACEHOLDER, blank, cut)
    out = base(text)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", cut):
        t = m[0]
        if len(t) < 20 or re.search(secrets.PLAIN, t) or re.search(secrets.WORDS, t) and not re.search(secrets.JUMBLED, t):
            continue
        hexadecimal = bool(re.fullmatch("[0-9a-fA-F]+", t))
        bits = secrets.HEX_BITS if hexadecimal else secrets.BASE64_BITS
        hot = [i for i in range(len(t) - secrets.WINDOW + 1) if entropy(t[i : i + secrets.WINDOW]) >= bits - 1e-9]
        if hot:
            out.append((m.start() + hot[0], 3 if hexadecimal else 4, m.start() + hot[-1] + secrets.WINDOW))
    return sorted(out)


def text_of(rng):
    parts = ["password", "Passwd", "SECRET", "token", "apikey", "API_KEY", ": ", "=", " = ", '"', "'", "\n", " ", "é😀", "AKIA", "AKIAIOSFODNN7EXAMPL", "deadbeef" * 5, "0123456789abcdef" * 2, "short", "abc_def-ghi.jkl", ", ", "Zx9Kq2Lm8Vw3Rt7Yp1Ns5Bd4Hg6Jf0", "550e8400-e29b-41d4-a716-446655440000"]
    out = [rng.choice(parts) for _ in range(rng.randint(0, 14))]
    if rng.random() < 0.4:
        out.append("".join(rng.choice("ABCDEFGHabcdefghijk0123456789+/_-=") for _ in range(rng.randint(15, 60))))
    if rng.random() < 0.3:
        out.append("".join(rng.choice("ABCDEF0123456789") for _ in range(rng.randint(15, 45))))
    rng.shuffle(out)
    return "".join(out)


def joined(found):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(7)
    texts = [text_of(rng) for _ in range(400)]
    texts += ["", None, "token: secret: abcdefghij", "x" * 50_000 + ' token = "abcdefgh1234"', 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "a word or two of plain text", "k 9233A8ECF7C5B09FE5949719B6B82BC439E9329B k"]
    return [(i if i != 3 else None, t) for i, t in enumerate(texts)]


def test_spans_equal_brute_force(spark, table):
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1)).withColumn("__spans", F.lit(2))
    got = secrets.scan(df).select("doc_id", F.sha2(secrets.joined(F.col("base")), 256), secrets.joined(F.col("spans"))).collect()
    want = [(i, hashlib.sha256(joined(base(t or "")).encode()).hexdigest(), joined(spans(t or ""))) for i, t in table]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any("entropy_hex" in w[2] for w in want) and any("entropy_base64" in w[2] for w in want)


def test_long_texts_with_many_matches(spark, monkeypatch):
    """Blocks of positions and of text, and a cost in proportion to the text."""
    rng = random.Random(3)
    key = lambda: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789", k=32))
    texts = ["😀 é ".join(f'token = "{key()}" {key()} word' for _ in range(n)) for n in (3, 300, 1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df).collect():
        assert secrets_of(r.spans) == spans(r.text) and len(r.spans) >= 2 * r.text.count("token")
    for r in secrets.secret_stage(df).collect():
        text = texts[r.doc_id]
        at, want = 0, []
        for start, _, end in spans(text):
            if start >= at:
                want += [text[at:start], "[secret]"]
            at = max(at, end)
        assert r.text == "".join(want) + text[at:]
    blob = "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789+/", k=60_000))
    assert secrets_of(secrets.scan(spark.createDataFrame([(1, f"x {blob} y")], "doc_id long, text string")).collect()[0].spans) == [(2, 4, 2 + len(blob))]


def secrets_of(found):
    return [(s.start, s.kind, s.end) for s in found]


def test_registered_query_shows_a_secret_that_no_pattern_knows(spark, tmp_path):
    rows = [(1, f"before {KEY} after"), (2, f'token = "{"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"}"'), (3, None), (4, "plain words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secrets.op7_secrets(spark, str(tmp_path)).collect()}
    assert got[1].spans == f"entropy_base64:7:{7 + len(KEY)}" and got[1].n_assign == got[1].n_access == got[1].n_hex == 0
    assert (got[2].n_assign, got[2].n_hex) == (1, 1) and [x.split(":")[0] for x in got[2].spans.split(",")] == ["assign", "hex", "entropy_hex"]
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(joined(base(t or "")).encode()).hexdigest()
    assert got[3].spans == got[4].spans == ""


def test_stage_redacts_and_keeps_columns(spark):
    secret = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    df = spark.createDataFrame([(1, f'é token = "{secret}" end', 99, "x"), (2, "clean", 5, "y"), (3, None, None, None)], "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in secrets.secret_stage(df).collect()}
    assert secrets.secret_stage(df).columns == df.columns
    assert out[1].text == 'é [secret]" end' and out[1].n_chars == len(out[1].text) and out[1].spans == "x"
    assert out[2].text == "clean" and out[3].text is None and out[3].n_chars is None
    assert secrets.secret_stage(df.limit(0)).count() == 0


def test_main_path_is_native(spark, table):
    df = spark.createDataFrame(table, "doc_id long, text string")
    plan = secrets.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


KEY = "Zx9Kq2Lm8Vw3Rt7Yp1Ns5Bd4Hg6Jf0"


def covered(spark, texts):
    got = secrets.scan(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(r.text[s.start : s.end].strip() == r.text[s.start : s.end] and 0 <= s.start < s.end <= len(r.text) for r in got for s in r.spans)
    return [[r.text[s.start : s.end] for s in r.spans] for r in got]


def test_names_beside_a_key_do_not_hide_it(spark):
    shouted = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    texts = [f"sample_conn={KEY}", f"/example/{KEY}", f"é😀 dummy-{KEY} é {KEY}=", f"{'x' * 9}/{KEY}", f"path/to/{shouted}/file", f"conn={shouted}", f"kJhGfDsQwErTyUiOpZxCvBnM and {KEY}"]
    assert all(any(x.endswith(KEY) or x in (KEY + "=", shouted) for x in found) for found in covered(spark, texts))
    assert len(covered(spark, texts)[-1]) == 2


def test_rest_of_a_run_beside_a_pattern_is_scored(spark):
    plain = "deadbeef" * 5
    found = covered(spark, [f"{plain}_{KEY}", f"token={plain}", f"{KEY}/{plain}/{KEY}"])
    assert any(KEY in x for x in found[0]) and plain in found[0]
    assert found[1] == [f"token={plain}", plain]
    assert sum(KEY in x for x in found[2]) == 2 and plain in found[2]


def test_parts_leave_plain_identifiers(spark):
    texts = ["some_long_identifier_name_42", "550e8400-e29b-41d4-a716-446655440000", "1234567890123456789012345", "Donaudampfschifffahrtsgesellschaft", "abcdefghijklmnopqrstuvwxyz0123456789", "x" * 50_000, "", None, "a = b"]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(F.size("spans")).collect()
    assert [r[0] for r in got] == [0] * len(texts)


def test_stage_takes_out_keys_beside_names(spark):
    df = spark.createDataFrame([(1, f"sample_conn={KEY} end", 1)], "doc_id long, text string, n_chars long")
    assert secrets.secret_stage(df).collect()[0].text == "sample_conn=[secret] end"
