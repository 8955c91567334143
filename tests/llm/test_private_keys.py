"""Private keys are found and masked with their bodies."""

import base64
import random

from linkspark.llm import secrets

HEAD, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def test_the_body_is_masked(spark):
    raw = base64.b64encode(random.Random(3).randbytes(1200)).decode()
    body = "\n".join(raw[i : i + 64] for i in range(0, len(raw), 64))
    short = body[:194] + "\nQUJDRA=="
    made = [
        (f"a {HEAD}\n{body}\n{END} b", "a <secret> b"),
        (f"a {HEAD}\n{short}\nand more", "a <secret>\nand more"),
        (f"a {HEAD}\n{short}", "a <secret>"),
        (f"secret: {HEAD}\n{body}\n{END}\nb", "secret: <secret>\nb"),
        (f"a {HEAD}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{body}\n{END}", "a <secret>"),
        (f"a {HEAD}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{short}\nend", "a <secret>\nend"),
        (f"{HEAD}{body}{END} mid {HEAD}\n{body}\n{END} z", "<secret> mid <secret> z"),
        (f"a {HEAD} b-c " + "d-e " * 20000, "a <secret> b-c " + "d-e " * 20000),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(made)}
    key = secrets.RULES.index(next(r for r in secrets.RULES if r.kind == "private_key"))
    spans = {r["k"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == key] for r in secrets.scan(df).collect()}
    assert spans[0] == [(2, len(made[0][0]) - 2)]
