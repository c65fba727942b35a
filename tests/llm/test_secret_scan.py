import hashlib
import random

from pyspark.sql import functions as F

from sessionlogs.llm import secret_scan
from tests.llm.helpers import awkward, documents


def kinds(text):
    return [(k, text[s:e]) for k, s, e in secret_scan.spans(text)]


def test_fixed_patterns():
    key, run = "AKIA" + "A1" * 7, "0123456789abcdef"
    assert kinds(f'x PassWord = "{"Q" * 12}" y') == [("assign", f'PassWord = "{"Q" * 12}')]
    assert kinds(f"password={'Q' * 11} {key} {key[:-1]} {run} {run[:-1]}") == [("access", key), ("hex", run)]
    assert kinds(f"api_key: {run}") == [("assign", f"api_key: {run}"), ("hex", run)]
    assert kinds("apikey=a.b+c/d_e=f-") == [("assign", "apikey=a.b+c/d_e=f-")]
    assert kinds("paſſword = aaaaaaaaaaaa toKen = " + "a" * 12) == [("assign", "toKen = " + "a" * 12)]  # no long s, no Kelvin sign


def test_values_that_are_hard_to_guess_are_added():
    assert kinds("the password is xK9#mQ2$vL.") == [("password", "xK9#mQ2$vL")]
    assert kinds("pwd: 'v9!Rt#2pLq'") == [("password", "v9!Rt#2pLq")]
    for easy in ("password1", "qwertyuiop", "changeme123", "2024-01-15", "aaaaaaaaaaaaaa", "${DB_PASSWORD}", "<redacted>"):
        assert kinds(f"the password is {easy}.") == []


def test_names_quotes_and_signs_of_configuration_files():
    value = "x9!Qz#7Lw"
    for before in ("DB_PASSWORD=", "AWS_SECRET_ACCESS_KEY=", '"db_password": "', "userPassword=", "dbpassword: ", "userPass=", "password\t=\t", "password:\n  ", "my-token => "):
        assert kinds(before + value + ('"' if before.endswith('"') else "")) == [("password", value)], before
    assert kinds('password: "x9! Qz#7Lw"') == [("password", "x9! Qz#7Lw")] and kinds("pwd='x9! Qz#7Lw'") == [("password", "x9! Qz#7Lw")]
    for value in ("$tr0ng!Pa55w", "%tr0ng!Pa55w", "{tr0ng!Pa55w", "<tr0ng!Pa55w", "[tr0ng!Pa55w", "${a}tr0ng!Pa55w"):
        assert kinds(f"password: {value}") == [("password", value)], value
    for filled in ("${DB_PASS!1:-x}", "{{ vault.db_secret!9 }}", "<your own pass-phrase>", "%(db_secret_9)s", "{db_secret_9}", "$DB_SECRET_9", "%DB_SECRET_9%", "$(cat /run/secret9)", "[db_secret_9]"):
        assert kinds(f"password: {filled}") == [] and kinds(f'password: "{filled}".') == [], filled
    assert kinds("token:\n  description: xK9#mQ2$vL") == [] and kinds("the compass is northbound") == []


def brute(value):
    """The cheapest segmentation by trying all of them."""
    n, infinite = len(value), float("inf")
    lower = value.lower()
    best = [0.0] + [infinite] * n
    for end in range(1, n + 1):
        for start in range(end):
            piece = value[start:end]
            costs = [secret_scan.CHARACTER * len(piece)]
            word = secret_scan._word(piece) if 2 <= len(piece) <= secret_scan.LONGEST_WORD else None
            costs += [] if word is None else [word]
            costs += [secret_scan.DATE_COST[len(piece) > 4]] if secret_scan.DATE.fullmatch(piece) else []
            costs += [secret_scan.log10(12 * len(piece))] if len(set(piece)) == 1 and len(piece) >= 3 else []
            walk = len(piece) >= 4 and all(b in secret_scan.NEXT.get(a, ()) for a, b in zip(lower[start:end], lower[start + 1 : end], strict=False))
            costs += [secret_scan.log10(47 * 4 * len(piece))] if walk else []
            best[end] = min(best[end], best[start] + secret_scan.SPAN + min(costs))
    return best[n]


def test_guesses_equal_brute_force():
    for v in ("a", "hunter2!", "Tr0ub4dor&3", "qwertyuiop12", "summer2024sun", "aaaabbbb1111", "x1999-12-31y", "PASSWORD", "p4$$word", "zxcvbnm,./q"):
        assert abs(secret_scan.guesses(v) - brute(v)) < 1e-9, v
    rng = random.Random(7)
    pieces = ["football", "password", "xxxx", "lll", "qwerty", "asdfgh", "fghjk", "2011", "1111", "aa", "s3cret", "-", "Zq", "1999-12-31", "dragon"]
    for _ in range(150):
        v = "".join(rng.choice(pieces) * rng.randint(1, 2) for _ in range(rng.randint(1, 5)))
        assert abs(secret_scan.guesses(v) - brute(v)) < 1e-9, v
    assert secret_scan.guesses("football" + "l" * 10) < 5


def test_prose_is_not_secret_and_blanks_are_not_bounded():
    for text in ("The secret is patience.", "The token is documented elsewhere", "password is encrypted at rest", "Password is case-sensitive", "secret: ingredients of cooking"):
        assert kinds(text) == [], text
    value = "x9!Qz#7Lw"
    assert kinds("password" + " " * 300 + "=" + " " * 300 + value) == [("password", value)]
    assert kinds("password:" + " " * 20 + "\n" + " " * 100 + value) == [("password", value)]
    assert kinds("password: ${" + "v" * 300 + "!9}") == []
    assert kinds('pwd: "korrekthorsebatteri"') == [("password", "korrekthorsebatteri")] and kinds("the password is kX9q2mZv") == [("password", "kX9q2mZv")]


def test_words_of_the_documents_are_easy(spark):
    rows = [(k, f"Über gardening and Xylophonist {k}, password=xylophonist") for k in range(6)] + [(9, "pwd=quetzalcoat"), (10, None)]
    docs = documents(spark, rows)
    words = secret_scan.learned_words(docs)
    assert {"über", "gardening", "xylophonist"} <= set(words) and "quetzalcoat" not in words
    out = {r.doc_id: r.spans for r in secret_scan.scan(docs, rank_of=words).collect()}
    assert out[0] == out[10] == "" and out[9] == "password:4:15"
    assert secret_scan.guesses("xylophonist") >= secret_scan.HARD > secret_scan.guesses("xylophonist", words)
    assert secret_scan.learned_words(docs.limit(0)) == secret_scan.RANK


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("spans", F.lit("clash")).withColumn("n_hex", F.lit("clash"))
    rows = secret_scan.scan(df).collect()
    assert len(rows) == 8 and {r.spans for r in rows} == {""} and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_very_long_values_are_read_whole():
    text = "password: " + "aB3$" * 20_000
    assert secret_scan.spans(text) == [("password", 10, 10 + 80_000)]
