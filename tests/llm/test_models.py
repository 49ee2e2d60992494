"""Language ID, decontamination, pseudonyms and toxicity: contracts, accuracy and odd rows."""

import datetime as dt
import math
import pickle
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.llm.cases import empty, frame, rows
from tidelog.llm import decontam, langid, pii, queries, toxicity

SF = "/root/testdata/sf0.01"


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


# Language ID


def test_language_of_documents(spark):
    truth = {d["doc_id"]: d["lang"] for d in documents()}
    got = queries.op3_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    assert np.mean([r["language"] == truth[r["doc_id"]] for r in got]) > 0.99
    assert np.mean([r["kept"] for r in got]) > 0.99


def test_language_without_declarations_of_half(spark):
    """Held out: half of the rows declare nothing, and some declare a wrong language."""
    truth, data = {}, []
    for d in documents():
        truth[d["doc_id"]] = d["lang"]
        declared = d["lang"] if d["doc_id"] % 2 else None
        data.append((d["doc_id"], d["text"], "en" if d["doc_id"] % 20 == 1 else declared, d["source"]))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in langid.identify(df).collect()}
    assert np.mean([got[i] == truth[i] for i in truth if i % 2 == 0]) > 0.97
    assert np.mean([got[i] == truth[i] for i in truth if i % 20 == 1]) > 0.95


def test_language_evidence_and_rejects(spark):
    docs = [(d["doc_id"], d["text"], d["lang"], d["lang"] + ".example") for d in documents()[:600]]
    short = [(9001, "de", None, "fr.example"), (9002, "de", None, "es.example")]
    junk = [(9003, "", "en", "x"), (9004, None, "en", "x"), (9005, "世界和平" * 30, None, "x"), (9006, "12345 67890 !!!", None, "x")]
    df = spark.createDataFrame(docs + short + junk, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert got[9001]["language"] == "fr" and got[9002]["language"] == "es"  # the host decides
    assert not any(got[i]["kept"] for i in (9003, 9004, 9005))


def test_language_of_pages(spark):
    got = queries.pages_language_id(spark, SF).collect()
    assert len(got) == pq.read_table(f"{SF}/pages.parquet").num_rows
    assert np.mean([r["language"] == r["declared"] for r in got]) > 0.95


def test_rare_languages_get_a_model(spark):
    """Twelve rows of a language among hundreds of others, whatever the size of the sample."""
    by = {}
    for d in documents():
        by.setdefault(d["lang"], []).append((d["doc_id"], d["text"], d["lang"], "s"))
    rare = by["es"][:12]
    df = spark.createDataFrame(by["en"][:400] + by["fr"][:100] + rare, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in langid.identify(df, rows_per_language=20).collect()}
    assert np.mean([got[i] == "es" for i, *_ in rare]) > 0.9
    plan = df.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 3")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # Spark keeps the first rows of a language before the shuffle


def _language_by_hand(data, temper=0.2):
    """The fusion with dictionaries: trigram likelihoods, declarations, and host, suffix and corpus priors."""
    plain = lambda t: bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in t.encode())
    grams = lambda t: [int((p[i] * 0x9E3779B1 + p[i + 1] * 0x85EBCA6B + p[i + 2] * 0xC2B2AE35) % 2**32) >> 17 for p in [b" " + plain(t) + b" "] for i in range(len(p) - 2)]
    n = Counter(d for _, _, d, _, _ in data if d)
    names = sorted(d for d in n if n[d] >= 8)
    tallies = {d: Counter(g for _, t, own, _, _ in data if own == d for g in grams(t or "")) for d in names}
    size = 1 << 15
    log = {d: (lambda g, c=c, total=sum(c.values()): math.log((c[g] + 0.05) / (total + 0.05 * size))) for d, c in tallies.items()}
    logs = {i: [sum(map(log[d], grams(t or ""))) for d in names] + [-math.log(size) * len(grams(t or ""))] for i, t, *_ in data}
    best = {i: max(range(len(names) + 1), key=lambda k: (x[k], -k)) if len(set(x)) > 1 else len(names) for i, x in logs.items()}
    whole = Counter(best.values())
    prior = [(whole[k] + 1) / (len(data) + len(names) + 1) for k in range(len(names) + 1)]
    count = lambda place: Counter((row[place], best[row[0]]) for row in data)
    by = {place: (count(place), Counter(row[place] for row in data)) for place in (2, 3, 4)}
    share = lambda place, row, k, p, w: (by[place][0][row[place], k] + w * p) / (by[place][1][row[place]] + w)
    out = {}
    for row in data:
        scores = []
        for k in range(len(names) + 1):
            host = share(3, row, k, share(4, row, k, prior[k], 50), 20)
            scores.append(temper * logs[row[0]][k] + math.log(host) + math.log(share(2, row, k, prior[k], 20)) - math.log(prior[k]))
        top = max(range(len(scores)), key=lambda k: (scores[k], -k))
        bare = not grams(row[1] or "")
        out[row[0]] = ("und", 0.0) if bare else ([*names, "und"][top], 1 / sum(math.exp(x - scores[top]) for x in scores))
    return out


def test_language_by_hand(spark):
    """Every evidence, with markup and address suffix, against plain Python."""
    pages = langid.page_columns(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    data = [tuple(r) for r in pages.collect()] + [(70_001, "", "en", "a.example.de", "de"), (70_002, "de la", None, "b.example.fr", "fr"), (70_003, "der die", "fr", "c.example.de", "de"), (70_004, None, None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, suffix string")
    got = {r["doc_id"]: (r["language"], r["probability"]) for r in langid.identify(df, suffix="suffix").collect()}
    want = _language_by_hand(data)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-3 for i in want)


def test_language_odd_rows(spark):
    assert langid.identify(frame(spark)).count() == len(rows())
    carried = langid.identify(frame(spark), carry=True)
    assert carried.select("row.*").columns == frame(spark).columns
    assert langid.identify(empty(spark)).count() == 0


# Decontamination


def test_leaks_of_documents(spark):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    found = {r["doc_id"]: set(r["items"]) for r in queries.op7_decontamination(spark, SF).collect()}
    for d in documents():
        assert {i["item_id"] for i in items if i["text"] in d["text"]} <= found[d["doc_id"]]
    assert sum(map(bool, found.values())) <= 1.1 * sum(any(i["text"] in d["text"] for i in items) for d in documents())


ITEM = "a train leaves Berlin at 9 and travels 240 km to Munich in 3 hours while a bus from Berlin needs 5 hours for the same 240 km so how fast is each"


@pytest.mark.parametrize(
    "text, leaked",
    [
        (ITEM, True),
        ("before it\n" + ITEM.replace("240", "360").replace("Berlin", "Lyon").replace("Munich", "Paris") + " and after", True),
        (ITEM.replace("240 km", "150 miles").replace("9", "11:30"), True),
        (ITEM.replace("240 km to", "250 km to").replace("9", "7").replace("leaves Berlin", "leaves Rome"), True),  # some slots disagree
        ("a train leaves Berlin at 9 and then nothing else that is like the item happens here at all", False),
        ("", False),
        (None, False),
    ],
)
def test_templates(spark, text, leaked):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "")], "item_id long, text string")
    (row,) = decontam.find(docs, items).collect()
    assert (row["leaked"], row["items"]) == (leaked, [7] if leaked else [])


def test_slots_must_agree(spark):
    item = "is 1 more than 2 or is 1 less than 2 or is 1 equal to 2 or is 1 half of 2"
    numbers = iter(range(10, 99))
    mixed = " ".join(str(next(numbers)) if w.isdigit() else w for w in item.split())
    docs = spark.createDataFrame([(1, mixed), (2, item.replace("1", "31").replace("2", "47"))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"]: r["leaked"] for r in decontam.find(docs, items).collect()} == {1: False, 2: True}


def _plain_windows(text, kind):
    """Distinct windows of a variant as word tuples with placeholders, by regular expressions."""
    mark = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    lower = lambda w: "".join(c.lower() if c < "\x80" else c for c in w)
    out, before, number_before = [], None, False
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        raw = m[0]
        word = raw.strip(mark) or raw
        opens = before is None or before[0][-1] in ".!?:" or "\n" in text[before[1] : m.start()]
        number = re.fullmatch(r"[0-9.,:/+%$-]*[0-9][0-9.,:/+%$-]*", word) or (n := re.fullmatch(r"[0-9][0-9.,:/+%$-]*([^0-9.,:/+%$-].*)", word)) and lower(n[1]) in decontam.UNITS
        capital = "A" <= word[0] <= "Z" and not number
        token = lower(word)
        if kind and number:
            token = 1
        elif kind and capital and (kind == decontam.WIDE or not opens):
            token = 2
        elif kind and number_before and not opens and token in decontam.UNITS:
            token = 3
        out.append(token)
        before, number_before = (raw, m.end()), bool(number)
    windows = [tuple(out[i : i + 5]) for i in range(len(out) - 4)]
    tells = [w for w in windows if sum(isinstance(x, str) for x in w) >= 2]
    return set(tells) if 2 * len(tells) >= len(windows) else set(), set(windows)


def test_leaks_by_hand(spark):
    """Every document with every item; templates that cover enough but disagree may differ only in slots."""
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    items = [(i["item_id"], i["text"]) for i in pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()]
    rng = random.Random(2)
    for k, (item, text) in enumerate(items[:40]):  # parts of items, with other numbers and cases
        words = text.split()
        cut = words[: int(len(words) * rng.choice([0.6, 0.74, 0.8, 0.9]))]
        docs.append((90_000 + k, "start here " + " ".join(w.upper() if k % 2 else w for w in cut) + " and so on"))
    got = {r["doc_id"]: set(r["items"]) for r in decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    own = {(i, kind): _plain_windows(t, kind) for i, t in items for kind in range(3)}
    for d, text in docs:
        held = [_plain_windows(text or "", kind)[1] for kind in range(3)]
        covers = lambda i, k: own[i, k][0] and len(own[i, k][0] & held[k]) >= 0.75 * len(own[i, k][0])
        must = {i for i, _ in items if covers(i, decontam.LITERAL)}
        assert must <= got[d] <= {i for i, _ in items if any(covers(i, k) for k in range(3))}
    assert sum(bool(got[90_000 + k]) for k in range(40)) >= 10


@pytest.mark.parametrize(
    "item, text, leaked",
    [
        ("what is two plus", "so what is two plus, he said", True),  # short items are windows of their own width
        ("what is two plus", "what is two or plus", False),
        ("yes", "yes it is", False),
        ("yes", "Yes!", True),
        ("Natalia sold 48 clips. Natalia then sold 24 more than before to her friends.", "Maria sold 30 clips. Maria then sold 17 more than before to her friends.", True),
        ("Ann met Bob near the River Thames at noon and Ann gave Bob a red book", "ann met bob near the river thames at noon and ann gave bob a red book", True),
        ("the parcel weighs 5kg and the crate weighs 7kg so how much is both", "the parcel weighs 9kg and the crate weighs 8kg so how much is both", True),
        ("so 1 and then 2 but 1 not 2 while 1 or 2 is more than 1 less 2", "so 6 and then 6 but 6 not 6 while 6 or 6 is more than 6 less 6", False),  # one value for two
        ("1 2 3 4 5 6 7 8 9", "7 7 1 3 3 5 4 4 2", False),  # a template of slots tells nothing
        ("1 2 3 4 5 6 7 8 9", "see 1 2 3 4 5 6 7 8 9", True),
    ],
)
def test_variants(spark, item, text, leaked):
    docs = spark.createDataFrame([(1, text), (2, text), (3, "something else that is long enough to have windows")], "doc_id long, text string")
    got = {r["doc_id"]: r["leaked"] for r in decontam.find(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: leaked, 2: leaked, 3: False}
    kept = decontam.without_leaks(docs.withColumns({"k1": F.lit(1), "a.b": F.lit(2), "row": F.lit(3)}), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "k1", "a.b", "row"] and kept.count() == (1 if leaked else 3)


def test_tables_of_numbers_are_aligned_in_linear_time():
    places = np.arange(200_000, dtype=np.int32)
    side = places, np.zeros(len(places), np.uint64), np.ones((len(places), 5), np.uint64)
    start = time.time()
    assert decontam.agreement(side, side) == 1.0 and time.time() - start < 20


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "x")], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontam.find(frame(spark), items).collect()}
    assert got[7] == [1] and got[6] == []
    assert decontam.find(empty(spark), items).count() == 0
    assert not any(r["leaked"] for r in decontam.find(frame(spark), items.limit(0)).collect())


# Pseudonyms

OWN = pii.Pseudonyms(b"k")
BACK = pii.Pseudonyms(b"k", inverse=True)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.data())
def test_feistel_is_a_permutation(size, data):
    network = pii.Feistel(b"k", "x", size)
    x = data.draw(st.integers(0, size - 1))
    assert network.inverse(network(x)) == x
    if size < 300:
        assert sorted(map(network, range(size))) == list(range(size))


def test_formats_stay():
    text = "card 4539 1488 0343 6467, ip 10.2.3.4, on 2021-02-28 or 3/14/1999 or 28.02.2021 or 4 July 1976, call +1 (528) 555-2987, ssn 078-05-1120, GB82 WEST 1234 5698 7654 32, Ann.b1@x.example.com."
    counts = [0] * len(pii.KINDS)
    new = OWN.text(text, counts)
    assert dict(zip(pii.KINDS, counts)) == {"email": 1, "iban": 1, "card": 1, "ip": 1, "phone": 1, "ssn": 1, "date": 4}
    assert BACK.text(new) == text
    for value in ("4539 1488 0343 6467", "10.2.3.4", "2021-02-28", "3/14/1999", "4 July 1976", "(528) 555-2987", "078-05-1120", "WEST", "Ann.b1"):
        assert value not in new
    words = new.replace(",", "").split(" ")
    assert pii.luhn("".join(words[1:5])) and max(map(int, words[6].split("."))) < 256
    dt.date.fromisoformat(words[8])


@settings(max_examples=100, deadline=None)
@given(st.dates(dt.date(1900, 1, 1), dt.date(2099, 12, 31)))
def test_dates(day):
    new = OWN.date(day.isoformat())
    dt.date.fromisoformat(new)
    assert BACK.date(new) == day.isoformat()


def test_invalid_values_stay():
    text = "4539148803436468 300.1.2.3 2021-02-30 31.02.2021 000-12-3456 GB82WEST12345698765433 1111111111111111 v1.2.3.4.5"
    assert OWN.text(text) == text


@pytest.mark.parametrize(
    "value, rest, kind",
    [
        ("4111 1111 1111 1111", " 12/26", "card"),
        ("4111111111111111", " 123", "card"),
        ("DE89370400440532013000", " EUR 50", "iban"),
        ("DE89 3704 0044 0532 0130 00", " BIC COBADEFF", "iban"),
        ("25/12/2020", "", "date"),
        ("January 12, 2020", "", "date"),
        ("12. März 2020", "", "date"),
        ("12 février 2020", "", "date"),
        ("12 de enero de 2020", "", "date"),
        ("a1" * 40 + "@example.org", "", "email"),
        ("x" * 60 + "@example.com", "", "email"),
        ("0171 1234567", "", "phone"),
        ("089/12345678", "", "phone"),
        ("01 23 45 67 89", "", "phone"),
        ("DE89 3704 0044 0532 0130 00", " OK", "iban"),
        ("25/12/1980", "", "date"),
        ("25-12-1980", "", "date"),
        ("1815-06-18", "", "date"),
        ("3.5.2150", "", "date"),
        ("1 May 1789", "", "date"),
    ],
)
def test_pseudonyms_leave_no_value(value, rest, kind):
    counts = [0] * len(pii.KINDS)
    new = OWN.text(f"see {value}{rest}", counts)
    assert value not in new and new.endswith(rest) and counts[pii.KINDS.index(kind)] == sum(counts) == 1
    assert new == f"see {OWN.text(value)}{rest}"


@settings(max_examples=60, deadline=None)
@given(st.dates())
def test_all_dates(day):
    new = OWN.date(day.isoformat())
    assert BACK.date(new) == day.isoformat() and (1900 <= day.year < 2100) == (1900 <= dt.date.fromisoformat(new).year < 2100)


def _value(kind, rng):
    """A valid value of a kind, by its own rules."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "card":
        body = rng.choice("3456") + digits(14)
        total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
        card = body + str(-total % 10)
        return rng.choice([card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), "-".join(card[i : i + 4] for i in range(0, 16, 4))])
    if kind == "iban":
        bare = digits(18)
        check = 98 - int(bare + "131400") % 97  # DE
        return f"DE{check:02d}{bare}"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "ssn":
        return f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
    if kind == "phone":
        return rng.choice([f"+{rng.randrange(1, 99)} {digits(3)} {digits(4)} {digits(3)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{rng.choice(['', '0'])}{rng.randrange(1, 10)}{digits(2)} {digits(7)}"])
    if kind == "email":
        return "".join(rng.choice("abcdefgh.12") for _ in range(rng.randrange(3, 90))).strip(".") + "x@mail.example.org"
    day = dt.date.fromordinal(rng.randrange(600_000, 800_000))
    return rng.choice([day.isoformat(), f"{day.day:02d}.{day.month:02d}.{day.year:04d}", f"{day.day} {rng.choice(['March', 'mai', 'Juni'])} {day.year:04d}" if day.day < 29 else day.isoformat()])


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_every_planted_value_is_found(seed):
    """Texts of valid values of all kinds: each is counted once, none stays, and the way back is exact."""
    rng = random.Random(seed)
    kinds = [rng.choice(pii.KINDS) for _ in range(rng.randrange(1, 6))]
    values = [_value(k, rng) for k in kinds]
    text = "".join(f"{rng.choice(['on', 'see:', 'und', '(', 'é'])} {v}{rng.choice([' and', ', then', '; or', '. Next', ')'])} " for v in values)
    counts = [0] * len(pii.KINDS)
    new = OWN.text(text, counts)
    assert counts == [kinds.count(k) for k in pii.KINDS]
    for v in values:
        assert v not in new
    if not any(k == "date" and re.search("[a-z]", v) for k, v in zip(kinds, values)):  # names of months may be of two languages
        assert BACK.text(new) == text


def test_day_first_dates_stay_apart():
    days = [f"{d}/{m:02d}/{y}" for y in (2019, 2020) for m in range(1, 13) for d in range(13, 29)]
    new = [OWN.text(d) for d in days]
    assert len(set(new)) == len(days) and [BACK.text(d) for d in new] == days


def test_pseudonyms_link_documents(spark):
    docs = spark.createDataFrame([(i, f"{i} pays with 4539148803436467 from 10.0.0.{i % 2}") for i in range(10)], "doc_id long, text string")
    got = [r["text"].split() for r in pii.pseudonymise(docs, b"k").orderBy("doc_id").collect()]
    assert len({w[3] for w in got}) == 1 and len({w[5] for w in got}) == 2
    assert pii.pseudonymise(docs, b"other").where("text like '%" + got[0][3] + "%'").count() == 0


def test_pseudonyms_of_documents(spark):
    got = {r["doc_id"]: r for r in queries.op8_pseudonyms(spark, SF).collect()}
    for d in documents():
        r = got[d["doc_id"]]
        assert pii.Pseudonyms(queries.KEY, inverse=True).text(r["text"]) == d["text"]
        assert len(r["text"].split()) == len(d["text"].split())
    assert sum(r["n_replaced"] for r in got.values()) > 80


def test_pseudonyms_odd_rows(spark):
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame(spark), b"k").collect()}
    assert got[0] is None and got[1] == "" and got[3] == rows()[3][1]
    assert pii.pseudonymise(empty(spark), b"k").count() == 0


# Toxicity


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    got = queries.op10_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10_000
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    toxic = [r["predicted"] for r in held if labels[r["doc_id"]]]
    clean = [r["predicted"] for r in held if not labels[r["doc_id"]]]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.03
    expected = np.mean([r["score"] for r in held])
    assert abs(expected - np.mean([labels[r["doc_id"]] for r in held])) < 0.04  # calibrated


def test_nearest_is_exact():
    """Cosines of all examples by dense products, on an index with ties, repeated examples and bare ones."""
    rng = random.Random(3)
    terms = 40
    vector = lambda: (lambda t: (np.array(sorted(t), np.int64), np.array([rng.randrange(1, 5) for _ in t])))(rng.sample(range(terms), rng.randrange(0, 9)))
    examples = [vector() for _ in range(600)]
    examples += examples[:100]
    factor = np.array([rng.random() + 0.5 for _ in range(terms)])
    index = toxicity.Index(factor, np.arange(700) % 2, examples)
    dense = np.zeros((700, terms))
    for i, (t, c) in enumerate(examples):
        dense[i, t] = index.weigh(t, c)
    queries_ = [vector() for _ in range(150)]
    for skip in (None, list(range(150))):
        for j, ((t, c), (cosines, found)) in enumerate(zip(queries_, index.nearest(queries_, 25, skip))):
            query = np.zeros(terms)
            query[t] = index.weigh(t, c)
            expected = np.round(dense @ query, 9)
            if skip:
                expected[j] = 0
            least = np.sort(expected)[-25]
            assert set(found.tolist()) == {i for i in range(700) if expected[i] > 0 and expected[i] >= least - 1e-9}
            assert np.allclose(cosines, expected[found], atol=2e-9)


def _score_by_hand(docs, labels, threshold=0.3):
    """The whole score with dictionaries: examples, weights, calibration and votes."""
    mark = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    bag = lambda t: Counter(w.strip(mark) or w for w in "".join(c.lower() if c < "\x80" else c for c in t or "").split())
    toxic = {}
    for i, _, y in labels:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            toxic[i] = max(y, toxic.get(i, 0))
    by_text = {}
    for i, t in docs:
        if i in toxic:
            by_text[t or ""] = max(toxic[i], by_text.get(t or "", 0))
    examples = [(bag(t), y) for t, y in by_text.items()]
    rate = sum(y for _, y in examples) / len(examples)
    frequency = Counter(w for _, t in docs for w in bag(t))
    a, b = Counter(w for x, y in examples if y for w in x), Counter(w for x, y in examples if not y for w in x)
    factor = {w: (math.log((len(docs) + 1) / (frequency[w] + 1)) + 1) * math.log2(2 + a[w] / max(1, b[w])) ** 2 for w in a | b}

    def vector(x):
        v = {w: (1 + math.log(n)) * factor[w] for w, n in x.items() if w in factor}
        norm = math.sqrt(sum(z * z for z in v.values()))
        return {w: z / norm for w, z in v.items()}

    held = [(vector(x), y) for x, y in examples]

    def vote(v, skip=None):
        near = sorted(((round(sum(z * e.get(w, 0) for w, z in v.items()), 9), y) for k, (e, y) in enumerate(held) if k != skip), reverse=True)
        near = [n for n in near if n[0] > 0 and n[0] >= near[min(24, len(near) - 1)][0]]
        return (sum(c * c * y for c, y in near) + 0.1 * rate) / (sum(c * c for c, _ in near) + 0.1)

    own = [(vote(v, k), y) for k, (v, y) in enumerate(held) if v]
    model = toxicity.Calibration(np.round([v for v, _ in own], 9), np.array([y for _, y in own], float), rate)
    bare = [y for v, y in held if not v]
    return [model.score(round(vote(v), 9)) if (v := vector(bag(t))) else (sum(bare) + rate) / (len(bare) + 1) for _, t in docs]


def test_toxicity_by_hand(spark):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()] + [(9001, None), (9002, "!!!! idiot!!!!")]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in pq.read_table("/root/testdata/sf0.001/labels.parquet").to_pylist()]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(*frames).collect()}
    assert np.allclose([got[i] for i, _ in docs], _score_by_hand(docs, labels), atol=1e-6)


def test_ids_are_no_input_of_toxicity():
    """Other ids and another order of the examples leave every vote as it is."""
    rng = np.random.default_rng(5)
    vectors = [(np.unique(rng.integers(0, 30, rng.integers(1, 6))), None) for _ in range(300)]
    vectors = [(t, np.ones(len(t), np.int64)) for t, _ in vectors] + [(np.array([3]), np.array([1]))] * 60
    labels = rng.integers(0, 2, 360)
    build = lambda order: toxicity.build(np.arange(30, dtype=np.uint64), np.full(30, 9), 360, order, labels[order], [vectors[i] for i in order])
    one, two = build(np.arange(360)), build(rng.permutation(360))
    assert [v for v, *_ in one.raw(vectors)] == [v for v, *_ in two.raw(vectors)]


def test_postings_bound_the_sample(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    shared, _ = toxicity.fit(docs, labels, sample_postings=5000)
    assert 0 < len(shared.value.terms) <= 5000
    again = pickle.loads(pickle.dumps(shared.value))
    assert all((getattr(again, n) == getattr(shared.value, n)).all() for n in ("vocabulary", "factor", "ids", "labels", "bounds", "terms", "counts"))


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (5, 1, 0), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark), labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in toxicity.score(frame(spark), labels.limit(0)).collect())
    assert toxicity.score(empty(spark), labels).count() == 0
