"""Classification of documents, headers and file names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

# Phrases and weights of each kind of document, in the order of ties.
KEYWORDS = {
    "fir": (("first information report", 8), ("fir no", 6), ("fir number", 6), ("fir/", 4), (" police station", 3), ("complainant", 4), ("accused", 3), ("under section", 4), ("u/s", 3), ("ipc", 3), ("it act", 3), ("cyber crime", 3), ("nccrp", 4), ("investigation", 1), ("cognizable", 3), ("registered the fir", 5)),
    "kyc": (("aadhaar", 6), ("aadhar", 6), ("permanent account number", 5), (" pan ", 3), ("pan card", 5), ("ckyc", 5), ("know your customer", 6), ("identity proof", 4), ("address proof", 4), ("voter id", 4), ("passport no", 4), ("driving licence", 4), ("driving license", 4), ("subscriber information", 5), ("customer id", 2), ("photograph", 2), ("date of birth", 2)),
    "cctv": (("cctv", 7), ("camera", 3), ("dvr", 4), ("nvr", 4), ("footage", 5), ("recording", 3), ("surveillance", 4), ("channel no", 3), ("video clip", 4), ("hard disk", 2)),
    "bank": (("account statement", 6), ("bank statement", 7), ("statement of account", 6), ("opening balance", 4), ("closing balance", 4), ("withdrawal", 3), ("deposit", 2), ("ifsc", 4), ("account number", 3), ("a/c no", 3), ("transaction", 2), ("upi", 3), ("imps", 3), ("neft", 3), ("rtgs", 3), ("debit", 2), ("credit", 2), ("branch", 1)),
}
# The least score of a kind, and the least lead over the next.
MIN_SCORE, MIN_MARGIN = 4, 2
# Header patterns and weights, in the order in which near-ties are decided.
HEADERS = {
    "cdr": ((r"\ba\s*party\b", 6), (r"\bb\s*party\b", 6), (r"call\s*type", 3), (r"call\s*date", 3), (r"call\s*duration|^\s*duration\s*$", 2), (r"first\s*cell|imei", 2), (r"target.*party|calling\s*party", 4)),
    "ipdr": ((r"msisdn|landline.*internet", 6), (r"public\s*ip|source\s*ip|destination\s*ip|ip\s*address", 5), (r"data\s*volume", 4), (r"pgw|session\s*duration|access\s*point", 3)),
    "bank": ((r"\bupi\b", 5), (r"description|narration|particulars", 4), (r"balance\s*closing|closing\s*balance", 5), (r"\bbalance\b", 2), (r"debit|credit|withdrawal|deposit|\bdr\s*amt\b|\bcr\s*amt\b|\bdr\b|\bcr\b", 3), (r"transaction\s*(id|date|amount)|tran\s*(id|date|type)|account\s*number|\bac\s*no\b|\bac\s*name\b", 3), (r"\bifsc\b|value\s*date|value\s*dt|pstd\s*dt", 2), (r"\bcust\s*id\b|\bcrncy\b", 2)),
}
# The least scores, and the headers of core-banking exports.
HEADER_MIN, HEADER_SECOND = 5, 5
CORE_BANKING = (r"\btran\s*id\b", r"\btran\s*date\b", r"\bpstd\s*dt\b", r"\bdr\s*amt\b", r"\bcr\s*amt\b", r"\bcust\s*id\b")


def _total(rules, test) -> Column:
    return sum((F.when(test(p), w).otherwise(0) for p, w in rules), F.lit(0)).cast("int")


def document_text(text: Column) -> Column:
    """The whole text in lower case, white space one space."""
    return F.lower(F.trim(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit(" ")), r"\s+", " ")))


def document_scores(t: Column, keywords: dict = KEYWORDS) -> dict[str, Column]:
    """The sum of each kind's phrases that a ``document_text`` holds, spaces at a phrase's
    ends not counting."""
    return {k: _total(rules, lambda p: F.contains(t, F.lit(p.strip()))) for k, rules in keywords.items()}


def merged_rules(overrides: dict, base: dict = KEYWORDS) -> dict:
    """The rules with more of them; a phrase and weight that is there, in any case, is not
    added again."""
    out = {k.lower(): list(rules) for k, rules in base.items()}
    for kind, rules in overrides.items():
        own = out.setdefault(kind.lower(), [])
        for phrase, weight in rules:
            if (phrase.lower(), int(weight)) not in {(p.lower(), w) for p, w in own}:
                own.append((phrase, int(weight)))
    return {k: tuple(rules) for k, rules in out.items()}


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text", keywords: dict = KEYWORDS) -> DataFrame:
    """``key, fir, kyc, cctv, bank, category, confidence, status``."""
    kinds = list(keywords)
    scores = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).select(key, "_t", document_text(F.col("_t")).alias("_n")).select(key, "_t", *[c.alias(k) for k, c in document_scores(F.col("_n"), keywords).items()])
    ranked = F.sort_array(F.array(*[F.struct(F.col(k).alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]), asc=False)
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    empty = F.trim("_t") == ""
    low = best["s"] < MIN_SCORE
    near = (best["s"] - second["s"] < MIN_MARGIN) & (second["s"] >= MIN_SCORE)
    return scores.select(
        key, *kinds, F.when(empty, "quarantine").when(low | near, "other").otherwise(best["k"]).alias("category"), F.when(empty | low, 0.0).when(near, 0.2).otherwise(F.least(F.lit(1.0), best["s"] / 16.0)).alias("confidence"),
        F.when(empty, "quarantined").otherwise("classified").alias("status"))


def header_kind(header: Column) -> Column:
    """cdr, ipdr, bank or quarantine from a header line; a near-tie of two strong kinds
    goes to the first in that order."""
    h = F.lower(header)
    totals = {k: _total(rules, lambda p: F.regexp_like(h, F.lit(p))) for k, rules in HEADERS.items()}
    ranked = F.sort_array(F.array(*[F.struct(c.alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, c) in enumerate(totals.items())]), asc=False)
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    tie = (best["s"] - second["s"] < 2) & (second["s"] >= HEADER_SECOND)
    first = F.when(F.greatest(best["o"], second["o"]) == best["o"], best["k"]).otherwise(second["k"])
    return F.when(best["s"] < HEADER_MIN, "quarantine").when(tie, first).otherwise(best["k"])


def core_banking(header: Column) -> Column:
    return sum((F.regexp_like(F.lower(header), F.lit(p)).cast("int") for p in CORE_BANKING), F.lit(0)) >= 3


def statement_json(text: Column) -> Column:
    return F.get_json_object(text, "$.account").isNotNull() & F.get_json_object(text, "$.transactions").isNotNull()


def filename_kind(name: Column) -> Column:
    """A hint from an upload's name, without the prefixes that filing adds."""
    n = F.lower(F.substring_index(name, "/", -1))
    n = F.regexp_replace(F.regexp_replace(n, r"^fir-\d{4}-\d+[_\-]", ""), r"^\d{8}_\d{6}_", "")
    stem = F.regexp_replace(n, r"\.[^.]*$", "")
    word = lambda w: F.regexp_like(n, F.lit(f"(^|[^a-z]){w}([^a-z]|$)"))
    has = lambda *ws: sum((F.contains(n, F.lit(w)).cast("int") for w in ws), F.lit(0)) > 0
    return (
        F.when(F.regexp_like(stem, F.lit(r"(^|[^0-9])[6-9]\d{9}\s*$")), "cdr")
        .when(has("unified_master_cdr") | word("cdr"), "cdr")
        .when(has("unified_master_ipdr") | word("ipdr"), "ipdr")
        .when(n.startswith("accounts") | has("accounts.csv"), "accounts")
        .when(n.startswith("transactions") | has("transactions.csv"), "transactions")
        .when(has("statement", "icore", "bank", "ledger") | word("stmt") | F.regexp_like(n, F.lit(r"\d{12,18}")), "bank")
        .when(F.regexp_like(n, F.lit(r"(^|[^a-z0-9])fir([^a-z0-9-]|$)")) | has("first information"), "fir")
    )


def resolve(user: Column, json: Column, core: Column, header: Column, document: Column, document_confidence: Column, name: Column) -> Column:
    """``category, reason, confidence``: what a user says, then content, then the name."""
    said = lambda c, why, p: F.struct(c.alias("category"), F.lit(why).alias("reason"), p.alias("confidence"))
    known = lambda c: c.isNotNull() & ~c.isin("quarantine", "other")
    return (
        F.when(user.isNotNull(), said(user, "user", F.lit(1.0)))
        .when(json, said(F.lit("bank"), "statement json", F.lit(0.92)))
        .when(core, said(F.lit("bank"), "core banking header", F.lit(0.9)))
        .when(known(header), said(header, "header", F.lit(0.88)))
        .when(known(document), said(document, "keywords", document_confidence))
        .when(name.isNotNull(), said(name, "file name", F.lit(0.65)))
        .otherwise(said(F.lit("quarantine"), "nothing found", F.lit(0.0)))
    )


# What each category is loaded as.
INGEST_KIND = {"cdr": "CDR", "ipdr": "IPDR", "bank": "BANK", "accounts": "BANK", "transactions": "BANK", "fir": "DOCUMENT", "kyc": "DOCUMENT", "cctv": "DOCUMENT"}


def ingest_kind(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in INGEST_KIND.items() for x in kv])
    return F.coalesce(F.try_element_at(table, category), F.lit("DOCUMENT"))


def report(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status", "category").agg(F.count(F.lit(1)).alias("n"))


def inventory(classified: DataFrame, name: str, k: int = 30) -> DataFrame:
    """How many of each category, and the k first names, which are found by rank. The
    categories are written once, or the texts were read and scored for each part and again
    for the filters that Spark infers."""
    from .browse import first_of

    found = written(classified.select("category", F.col(name).cast("string").alias("name")), "inventory")
    n = found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    some = first_of(found, ["category"], ["name"], k)
    return n.join(some.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")), "category")


# Names of banks that file names have.
BANKS = (
    "axis", "bandhan", "bank of baroda", "bob", "baroda", "canara", "central bank of india", "city union", "federal bank", "hdfc", "icici", "idbi", "idfc", "kotak", "pnb",
    "punjab national", "rbl", "sbi", "state bank", "union bank", "utkarsh", "varachha", "yes", "yes bank",
)


def bank_name(filename: Column, more: tuple[str, ...] = (), unsorted: str = "_unsorted") -> Column:
    """The bank whose name, the longest first, is in the compacted file name."""
    compact = F.regexp_replace(F.lower(filename), "[^a-z0-9]", "")
    longest = sorted({*BANKS, *more}, key=lambda name: (-len(name), name.lower()))
    said = [F.when(F.contains(compact, F.lit("".join(c for c in name.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789"))), F.lit(name)) for name in longest]
    return F.coalesce(*said, F.lit(unsorted))


# Words that headers have.
CUE_WORDS = ("party", "date", "time", "duration", "imei", "msisdn", "upi", "debit", "credit", "narration", "description", "balance", "ip", "account", "call", "cell")


def header_row(rows: DataFrame, scan: int = 40) -> DataFrame:
    """``path, line_no, score``: of each file's leading rows (path, line_no, cells) the
    first with the most cue words in its cells; rows of fewer than two cells, or of
    numbers for the most part, are none."""
    clean = F.filter(F.transform("cells", lambda c: F.btrim(F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" ")), r"\s+", " "), F.lit(" :.-"))), lambda c: c != "")
    found = rows.where(F.col("line_no") < scan).select("path", "line_no", clean.alias("c")).where("size(c) >= 2")
    numbers = F.size(F.filter("c", lambda c: F.regexp_like(F.replace(c, F.lit(" "), F.lit("")), F.lit(r"^[\d.,]+$"))))
    hits = lambda c: sum((F.contains(c, F.lit(w)).cast("int") for w in CUE_WORDS), F.lit(0))
    scored = found.where(numbers / F.size("c") <= 0.5).select("path", "line_no", F.aggregate("c", F.lit(0), lambda s, c: s + hits(c)).alias("score"))
    best = scored.groupBy("path").agg(F.max_by(F.struct("line_no", "score"), F.struct("score", -F.col("line_no"))).alias("b"))
    return best.select("path", "b.*")


def resniffed(kind: Column, detected: Column, sniffed: Column, name: Column) -> Column:
    """What a document is loaded as when it is loaded again: by what it was filed as,
    but for what its header says, a phone number in its name, and, where nothing else
    is known, words of its name."""
    load = F.create_map(*[F.lit(x) for k in ("bank_statement", "bank", "accounts", "transactions") for x in (k, "bank_statement")], F.lit("cdr"), F.lit("cdr"), F.lit("ipdr"), F.lit("ipdr"))
    filed = F.coalesce(F.try_element_at(load, F.lower(kind)), F.try_element_at(load, F.lower(detected)))
    n = F.lower(name)
    table = F.regexp_like(n, F.lit(r"\.(csv|tsv|xlsx|xls|xlsm)$"))
    said = F.when(table, F.lower(sniffed))
    phone = F.regexp_like(F.regexp_replace(n, r"\.[^.]*$", ""), F.lit(r"(?<!\d)[6-9]\d{9}(?!\d)"))
    named = F.regexp_like(n, F.lit(r"\.(xlsx|xls|xlsm|csv|pdf)$")) & F.regexp_like(n, F.lit("stmt|statement|icore|bank|ledger|account"))
    return F.when(phone, "cdr").when(said.isin("cdr", "ipdr"), said).when((said == "bank") & ~F.coalesce(filed.isin("cdr", "ipdr"), F.lit(False)), "bank_statement").otherwise(F.coalesce(filed, F.when(named, "bank_statement")))


# Endings of tables and of texts; patterns of core-banking exports, of which
# three suffice; how sure each way of telling is.
TABLE_ENDINGS = ("csv", "tsv", "xls", "xlsx", "xlsm")
TEXT_ENDINGS = ("pdf", "doc", "docx", "txt", "html", "htm", "eml", "jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp", "gif")
EXPORT_SIGNS = (
    r"narration|description|particulars", r"\bdr\s*amt\b|\bcr\s*amt\b|debit|credit", r"tran\s*date|transaction\s*date|\bdate\b", r"\bac\s*no\b|account\s*(no|number)|a/?c",
    r"\bbalance\b", r"tran\s*id|transaction\s*id",
)
SURE = {"calls": 0.92, "ledger": 0.88, "named ledger": 0.9, "export": 0.9, "name of a table": 0.65, "name": 0.8, "folder": 0.95, "statement": 0.92, "schema": 0.95, "other json": 0.4, "bank by name": 0.65, "weak": 0.5, "unknown ending": 0.45, "nothing": 0.3}


def statement_schema(text: Column) -> Column:
    """Whether a JSON text is a bank's statement: by words near its start, or by its fields."""
    head = F.lower(F.left(text, F.lit(4096)))
    has = lambda *words: sum((F.contains(head, F.lit(f'"{w}"')).cast("int") for w in words), F.lit(0)) > 0
    near = has("bank_statement") | F.contains(head, F.lit('"document_type": "bank_statement"')) | (has("statement_id") & has("transactions", "account", "bank"))
    of = lambda path: F.get_json_object(text, path)
    kind = F.upper(of("$.document.document_type")) == "BANK_STATEMENT"
    whole = (F.coalesce(of("$.statement_id"), F.lit("")) != "") & (F.startswith(of("$.transactions"), F.lit("[")) | F.startswith(of("$.account"), F.lit("{")))
    return F.coalesce(near, F.lit(False)) | F.coalesce(kind, F.lit(False)) | F.coalesce(whole, F.lit(False))


def upload_kind(name: Column, header: Column, text: Column, keyword: Column, sure: Column, filed: Column, known: Column) -> Column:
    """``category, confidence`` of an upload. A table goes by its header, then by the signs of
    an export, then by its name. Anything else goes by a name of calls or sessions, by a bank's
    folder (``filed``) or statement (``known``) that it belongs to, as JSON by its schema, as
    text by its ``keyword`` category (and how ``sure`` that is), where the name may know better,
    and by its name alone."""
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    table, text_file, json = ending.isin(*TABLE_ENDINGS), ending.isin(*TEXT_ENDINGS), ending == "json"
    hint, said = F.coalesce(filename_kind(name), F.lit("")), header_kind(header)
    export = sum((F.regexp_like(F.lower(header), F.lit(p)).cast("int") for p in EXPORT_SIGNS), F.lit(0)) >= 3
    ledger = hint.isin("accounts", "transactions")
    unsure = keyword.isin("quarantine", "fir", "other")
    rules = [
        (table & said.isin("cdr", "ipdr"), said, "calls"),
        (table & (said == "bank") & ledger, hint, "named ledger"),
        (table & (said == "bank"), said, "ledger"),
        (table & export, F.lit("bank"), "export"),
        (table & hint.isin("cdr", "ipdr", "bank", "accounts", "transactions"), hint, "name of a table"),
        (table, F.lit("quarantine"), None),
        (hint.isin("cdr", "ipdr"), hint, "name"),
        (filed, F.lit("bank"), "folder"),
        (known & (ending.isin("pdf", *TABLE_ENDINGS, "json") & (ending != "tsv")), F.lit("bank"), "statement"),
        (json & statement_schema(text), F.lit("bank"), "schema"),
        (json, F.lit("other"), "other json"),
        (text_file & unsure & (hint == "bank"), hint, "bank by name"),
        (text_file & (keyword == "quarantine") & (hint != ""), hint, "weak"),
        (text_file, keyword, sure),
        (hint != "", hint, "unknown ending"),
        (F.lit(True), F.lit("other"), "nothing"),
    ]
    level = lambda x: x if isinstance(x, Column) else F.lit(SURE[x] if x else 0.0)
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.struct(kind.alias("category"), level(p).cast("double").alias("confidence"))) for test, kind, p in rules])
