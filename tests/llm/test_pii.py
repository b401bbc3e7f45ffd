import random
import re

from pyspark.sql import functions as F

from lociflow.llm import common, pii


def run(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    found = {r.doc_id: r for r in pii.surrogate(docs, key, counted="found").collect()}
    return [found[i] for i in range(len(texts))]


def test_formats_and_coreference(spark):
    texts = [
        "write anna.b-1@mail7.example.com or +1 (017) 555-7713 now",
        "WRITE ANNA.B-1@MAIL7.EXAMPLE.COM!! card 4111 1111 1111 1111, 97.51.17.173.",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 123-45-6789',
        "Mrs. Anna Smith met Mr Smith and г-жа Петрова; Mrs Anna left",
        None,
        "",
        "version 2.0 of 12 items",
        "card 4111-1111-1111-1111",
    ]
    out = run(spark, texts)
    assert [r.found for r in out] == [2, 3, 2, 4, 0, 0, 0, 1]
    assert out[4].text is None and out[5].text == "" and out[6].text == texts[6]
    a = re.fullmatch(r"write ([a-z]{4}\.[a-z]-\d@[a-z]{4}\d\.[a-z]{7}\.example) or (\+1 \(\d{3}\) \d{3}-\d{4}) now", out[0].text)
    assert a and "anna" not in out[0].text and "555-7713" not in out[0].text
    b = re.fullmatch(r"WRITE (\S+)!! card (\d{4} \d{4} \d{4} \d{4}), (\d+\.\d+\.\d+\.\d+)\.", out[1].text)
    assert b[1] == a[1].upper() and b[2] != "4111 1111 1111 1111" and b[3] != "97.51.17.173"
    assert out[7].text == "card " + b[2].replace(" ", "-")
    assert re.fullmatch(r'token = "[0-9a-f]{40}" \d{3}-\d{2}-\d{4}', out[2].text) and "04dbeb" not in out[2].text
    n = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+) and г-жа ([а-яА-Я]+); Mrs (\w+) left", out[3].text)
    assert n and n[1].lower() in [g.lower() for g in pii.GIVEN["latin", "f"]] and n[1] != "Anna" and n[4].endswith("ова")
    assert out[0].n == "x"


def test_surrogates_stay_distinct(spark):
    texts = [f"Mr {chr(65 + i % 26)}{'abcdefghij'[i // 26]}lo Stone" for i in range(200)]
    names = {r.text.split()[1] for r in run(spark, texts)}
    assert len(names) == 200 and not names & {t.split()[1] for t in texts}


def test_same_key_same_result_other_key_other_result(spark):
    t = ["id 123-45-6789"]
    one, two, other = run(spark, t)[0].text, run(spark, t)[0].text, run(spark, t, "z")[0].text
    assert one == two != other


def test_long_and_repeated_texts(spark):
    long = "a." * 60_000 + " x@y.org " + "9" * 50_000
    out = run(spark, [long, long])
    assert out[0].text == out[1].text and out[0].found == 1 and out[0].text.startswith("a.a.") and "x@y.org" not in out[0].text


def test_empty_table(spark):
    assert pii.surrogate(spark.createDataFrame([], "doc_id long, text string"), "k").collect() == []


def test_adjacent_entities_and_short_phone_groups(spark):
    texts = [
        "call +1 (826) 555-4081 190.137.223.204 now",
        "190.137.223.204 +33 1 23 45 67 89 10.0.0.1 end",
        "or 555.123.4567, 555 123 4567 and 212 555 0100.",
        "card 4111 1111 1111 1111 and 1.555.123.4567 stay apart",
        "+1 (826) 555-4081",
        "+49.30.1234.5678.90 and 190.137.223.204",
    ]
    out = run(spark, texts)
    assert [r.found for r in out][:5] == [2, 3, 3, 1, 1]
    a = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) (\d+\.\d+\.\d+\.\d+) now", out[0].text)
    b = re.fullmatch(r"(\d+\.\d+\.\d+\.\d+) (\+33 \d \d\d \d\d \d\d \d\d) 10\.0\.0\.1 end|(\d+\.\d+\.\d+\.\d+) (\+33 \d \d\d \d\d \d\d \d\d) (\S+) end", out[1].text)
    assert a and b and a[2] == (b[1] or b[3]) != "190.137.223.204" and a[1] == out[4].text != texts[4]
    assert re.fullmatch(r"or \d{3}\.\d{3}\.\d{4}, \d{3} \d{3} \d{4} and \d{3} \d{3} \d{4}\.", out[2].text) and "4567" not in out[2].text
    assert "1.555.123.4567" in out[3].text
    assert out[5].text.split(" and ")[1] == a[2]


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_check_digits_and_versions_of_addresses(spark):
    texts = ["pay DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819 by 4539 1488 0343 6467, not 4539 1488 0343 6468", "at 2001:db8:85a3:0:0:8a2e:370:7334 and FE80::1 since 12:34:56, std::max"]
    pay, at = (r.text for r in run(spark, texts))
    a = re.fullmatch(r"pay (DE\d\d(?: \d{4}){4} \d\d) or (GB\d\d[A-Z]{4}\d{14}) by (\d{4} \d{4} \d{4} \d{4}), not (\d{4} \d{4} \d{4} \d{4})", pay)
    assert a and iban(a[1].replace(" ", "")) and iban(a[2]) and luhn(a[3].replace(" ", "")) and not set(a.groups()) & set(re.findall(r"[A-Z0-9 ]{16,}", texts[0]))
    b = re.fullmatch(r"at ([0-9a-f]+(?::[0-9a-f]+){7}) and ([0-9A-F]{4}::\d|[0-9A-F]{4}::[A-F]) since 12:34:56, std::max", at)
    assert b and "8a2e" not in b[1] and [len(x) for x in b[1].split(":")] == [4, 3, 4, 1, 1, 4, 3, 4]


def test_couples_share_and_others_do_not(spark):
    """10,000 names of both genders: the family name of a couple stays one, no two people's full names meet."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"Q{letters[i // 26 % 26]}{letters[i % 26]}{letters[i // 676]}k" for i in range(5000)]
    text = "; ".join(f"Mr {n} and Mrs {n}" for n in names)
    out = run(spark, [text])[0].text
    pairs = [re.fullmatch(r"Mr (\w+) and Mrs (\w+)", x).groups() for x in out.split("; ")]
    assert len(pairs) == 5000 and all(a == b for a, b in pairs)
    assert len({a for a, _ in pairs}) == 5000 and not {a for a, _ in pairs} & set(names)


def test_scripts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "пётр.и@mail.ru", 5)], "doc_id long, text string, text_md int").selectExpr("*", "1 AS replacements", "2 AS _new", "3 AS _k")
    r = pii.surrogate(docs, "k").first()
    assert r.asDict().keys() == dict.fromkeys(docs.columns).keys() and re.fullmatch(r"[а-яё]{4}\.[а-яё]@[a-z]{4}\.example", r.text) and r[2:] == (5, 1, 2, 3)


def test_draws_end_where_real_forms_leave_no_room(spark):
    """Forms of which most or all are real: later rounds draw longer ones, all distinct and none of them real."""
    rng = random.Random(5)
    addresses = rng.sample([f"{a:x}::{b:x}" for a in range(16) for b in range(16) if not f"{a:x}{b:x}".isalpha()], 200)
    numbers = rng.sample([f"+1 {a:02d} {b:02d}" for a in range(10, 100) for b in range(10, 100)], 6000)
    docs = spark.createDataFrame([(1, " , ".join(addresses)), (2, " ; ".join(numbers)), (3, " , ".join(addresses[:5]))], "doc_id long, text string")
    folder = common.shared_dir(spark)
    out = {r.doc_id: r.text for r in pii.surrogate(docs, "k", folder=folder).collect()}
    new, phones = out[1].split(" , "), out[2].split(" ; ")
    assert len(set(new)) == len(addresses) and not set(new) & set(addresses) and out[3].split(" , ") == new[:5]
    assert len(set(phones)) == len(numbers) and not set(phones) & set(numbers)
    assert all(re.fullmatch(r"(?:[0-9a-f]{1,4}:)+(?::[0-9a-f]{1,4})+", x, re.I) for x in new)
    kinds = spark.createDataFrame([(x,) for x in phones], "e string").select(pii.classify(F.col("e")).alias("kind")).distinct()
    assert [r.kind for r in kinds.collect()] == ["phone"]
