import datetime
import hashlib
import ipaddress
import random
import re

import pytest

from lodestone.llm import pii

KEY = "a test key"


def luhn(s):
    digits = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def run(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.pseudonyms(df, key).collect()}


CASES = {
    "email": ["und.34@mail7.example.com", "Anna_Smith+x@example.org"],
    "phone": ["+1 (974) 555-3436", "+49 30 1234567", "(974) 555-3436", "974-555-3436"],
    "ip": ["97.51.17.173", "255.0.0.1"],
    "card": ["4845168114407329", "4845 1681 1440 7329", "4845-1681-1440-7329", "378282246310005"],
    "date": ["2020-02-29", "31.12.1999", "07/04/1976"],
    "ssn": ["123-45-6789", "899-99-9999"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
}


@pytest.mark.parametrize("kind", CASES)
def test_values_keep_their_format(spark, kind):
    values = CASES[kind]
    found = run(spark, [f"before {v}, after." for v in values])
    for i, v in enumerate(values):
        r = found[i]
        new = r["text"][len("before ") : -len(", after.")]
        assert r["text"].startswith("before ") and r["text"].endswith(", after.") and new != v and r[f"n_{kind}"] == 1
        assert sum(r[f"n_{k}"] for k in pii.KINDS) == 1
        if kind != "ip":
            assert re.sub(r"[0-9]", "0", re.sub("[A-Za-z]", "a", new)) == re.sub(r"[0-9]", "0", re.sub("[A-Za-z]", "a", v))
        if kind == "card":
            assert luhn(new)
        elif kind == "iban":
            assert mod97(new) == 1 and new[:2] == v[:2]
        elif kind == "ip":
            assert all(0 <= int(x) < 256 for x in new.split("."))
        elif kind == "date":
            form = "%Y-%m-%d" if v[4] == "-" else "%d.%m.%Y" if v[2] == "." else "%m/%d/%Y"
            assert 1900 <= datetime.datetime.strptime(new, form).year <= 2099
        elif kind == "ssn":
            assert not re.search("^(000|666|9)|-00-|-0000$", new)
        elif kind == "email":
            assert new.split("@")[1] == v.split("@")[1]


def test_what_fails_its_check_stays(spark):
    texts = ["4845168114407328", "9807915762804490", "300.1.1.1", "2021-02-29", "30.02.2020", "000-12-3456", "GB82 WEST 1234 5698 7654 33", "Version 2.0.", "12345", "no values at all", "a@b", "1.2.3.4.5"]
    assert [run(spark, texts)[i]["text"] for i in range(len(texts))] == texts


def test_equal_values_stay_linked_and_different_ones_apart(spark):
    cards = [f"{n}{next(d for d in range(10) if luhn(f'{n}{d}'))}" for n in range(411111111111000, 411111111111300)]
    found = run(spark, [f"{c} x {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}" for c in cards])
    new = [found[i]["text"].split(" x ") for i in range(len(cards))]
    assert all(a == b.replace(" ", "") for a, b in new) and len({a for a, _ in new}) == len(cards)
    other = run(spark, [cards[0]], "another key")[0]["text"]
    assert other != new[0][0]
    phones = run(spark, ["+1 (974) 555-3436 and +1 974 555 3436"])[0]["text"]
    a, b = phones.split(" and ")
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)


def test_permutations_are_onto(spark):
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(days=29 * i)).isoformat() for i in range(2500)]
    found = run(spark, [" ".join(days)])[0]
    assert len(set(found["text"].split())) == len(days) == found["n_date"]
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(1000)]
    assert len(set(run(spark, [" ".join(ips)])[0]["text"].split())) == 1000


def test_awkward(awkward, empty):
    found = pii.pseudonyms(awkward, KEY)
    assert found.columns == [*awkward.columns, *(f"n_{k}" for k in pii.KINDS)]
    assert sorted(str(r["text"]) for r in found.collect()) == sorted(str(r["text"]) for r in awkward.collect())
    assert pii.pseudonyms(empty, KEY).count() == 0
    assert pii.pseudonyms(awkward, "it's \\ %", counts=False).columns == awkward.columns
    with pytest.raises(ValueError):
        pii.pseudonyms(awkward, "")


# ---------------------------------------------------------------- brute force


def shifted(x, seed):
    digest = hashlib.sha256(seed.encode()).digest()
    out = ""
    for p, c in enumerate(x):
        for low, n in (("0", 10), ("a", 26), ("A", 26)):
            if ord(low) <= ord(c) < ord(low) + n:
                c = chr(ord(low) + (ord(c) - ord(low) + digest[p % 32]) % n)
                break
        out += c
    return out


def permuted(x, kind):
    left, right = x[: len(x) // 2], x[len(x) // 2 :]
    for i in range(1, 11):
        if i % 2:
            right = shifted(right, f"{KEY}|{kind}|{i}|{left}")
        else:
            left = shifted(left, f"{KEY}|{kind}|{i}|{right}")
    return left + right


def permuted_number(x, a, b, kind):
    sides, sizes = list(divmod(x, b)), (a, b)
    for i in range(1, 11):
        own = i % 2
        digest = hashlib.sha256(f"{KEY}|{kind}|{i}|{sides[1 - own]}".encode()).hexdigest()
        sides[own] = (sides[own] + int(digest[:15], 16)) % sizes[own]
    return sides[0] * b + sides[1]


def placed(form, values):
    values = iter(values)
    return "".join(next(values) if re.fullmatch("[A-Z0-9]", c) else c for c in form)


def pseudonym(kind, v):
    digits = re.sub(r"\D", "", v)
    if kind == "email":
        name, at, host = v.rpartition("@")
        return permuted(name.lower(), kind) + at + host
    if kind == "iban":
        body = permuted(v.replace(" ", "")[4:], kind)
        return placed(v, v[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in body + v[:2] + '00')) % 97:02}" + body)
    if kind == "ip":
        return str(ipaddress.ip_address(permuted_number(int(ipaddress.ip_address(v)), 1 << 16, 1 << 16, kind)))
    if kind == "date":
        form = "%Y-%m-%d" if v[4] == "-" else "%d.%m.%Y" if v[2] == "." else "%m/%d/%Y"
        zero = datetime.datetime(1900, 1, 1)
        return (zero + datetime.timedelta(permuted_number((datetime.datetime.strptime(v, form) - zero).days, 17, 4297, kind))).strftime(form)
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        n = permuted_number((areas.index(int(v[:3])) * 99 + int(v[4:6]) - 1) * 9999 + int(v[7:]) - 1, 898 * 99, 9999, kind)
        return f"{areas[n // 9999 // 99]:03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}"
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|", v).group()
        return country + placed(v[len(country) :], permuted(re.sub(r"\D", "", v[len(country) :]), kind))
    body = permuted(digits[:-1], kind)
    return placed(v, body + next(str(d) for d in range(10) if luhn(f"{body}{d}")))


def valid(kind, v):
    digits = re.sub(r"\D", "", v)
    if kind == "iban":
        return bool(re.fullmatch(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}", v)) and mod97(v) == 1
    return 13 <= len(digits) <= 19 and luhn(v) and bool(re.fullmatch(r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}", v))


def test_the_values_and_their_pseudonyms_are_those_of_brute_force(spark):
    """Values beside words, capitals and further groups: a plain search finds them again, and a plain network renames them."""
    rng = random.Random(3)
    after = ["", ".", " 123", " 12/27", " EUR", " 2024", ", x", " (old)", "\n", " 7 of 9"]
    before = ["", "No. ", "2024 ", "AB12 3456 ", "at ", "№", "(", "x "]
    texts, want = [], []
    for _ in range(300):
        kind = rng.choice([*CASES])
        v = rng.choice(CASES[kind])
        if kind == "card":
            n = "".join(rng.choice("0123456789") for _ in range(15))
            v = n + next(str(d) for d in range(10) if luhn(f"{n}{d}"))
            if rng.random() < 0.6:
                v = rng.choice(" -").join(v[k : k + 4] for k in range(0, 16, 4))
        a, b = rng.choice(before), rng.choice(after)
        whole = f"{a}{v}{b}"
        if kind in ("iban", "card"):  # the longest beginning at the first place that has one, by trying all
            spans = [(i, j) for i in range(len(whole)) for j in range(len(whole), i, -1) if valid(kind, whole[i:j]) and not (i and whole[i - 1].isalnum()) and not (j < len(whole) and whole[j].isalnum())]
            i, j = min(spans, key=lambda s: (s[0], -s[1]))
            want.append(whole[:i] + pseudonym(kind, whole[i:j]) + whole[j:])
        elif kind == "phone" and v[0] == "+" and b[:2].strip().isdigit():
            continue  # further digits may belong to it
        else:
            want.append(a + pseudonym(kind, v) + b)
        texts.append(whole)
    found = run(spark, texts)
    assert [found[i]["text"] for i in range(len(texts))] == want


@pytest.mark.parametrize("text", ["card 4845168114407329 123", "card 4845 1681 1440 7329 12/27", "IBAN BE68 5390 0754 7034 EUR", "IBAN BE68 5390 0754 7034 2024", "AB12 3456 4845-1681-1440-7329 x", "2024 4845 1681 1440 7329", "call 974 555 3436"])
def test_further_groups_hide_nothing(spark, text):
    found = run(spark, [text])[0]
    assert found["text"] != text and sum(found[f"n_{k}"] for k in pii.KINDS) == 1


def test_marks_of_the_search_may_stand_in_a_text(spark):
    text = "\ufdd0 a \ufdd0\ufdd1\ufdd2 \ufdd2 10.0.0.1 \ufdd0"
    found = run(spark, [text, "\ufdd0"])
    assert found[0]["text"] == text.replace("10.0.0.1", pseudonym("ip", "10.0.0.1")) and found[1]["text"] == "\ufdd0"


def test_no_plan_shows_the_key(small, capsys):
    pii.pseudonyms(small, KEY).explain("extended")
    assert KEY not in capsys.readouterr().out


def test_long_runs_of_digits(spark):
    text = "1 " * 30_000 + "4845168114407329 " * 200 + "5" * 100_000
    found = run(spark, [text])[0]
    assert found["n_card"] == 200 and len(found["text"]) == len(text) and "4845168114407329" not in found["text"]


def test_native(small):
    plan = pii.pseudonyms(small, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nothing_planted_is_left(small):
    old = {r["doc_id"]: r["text"] for r in small.collect()}
    patterns = [r"[\w.]+@[\w.]+\.com", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)"]
    n = 0
    for r in pii.pseudonyms(small, KEY).collect():
        values = [v for p in patterns for v in re.findall(p, old[r["doc_id"]])] + [v for v in re.findall(r"(?<!\d)\d{16}(?!\d)", old[r["doc_id"]]) if luhn(v)]
        n += len(values)
        assert not any(v in r["text"] for v in values)
        if not values:
            assert r["text"] == old[r["doc_id"]]
    assert n > 10
