import datetime
import hashlib
import random
import re

import regex

from seamline.llm import pii


def luhn(s):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(re.sub(r"\D", "", s)))) % 10 == 0


def texts(df, **kw):
    return {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, **{"key": "k", **kw}).collect()}


def test_formats_and_links(documents):
    d = documents([
        (1, "card 4845168114407329, again 4845-1681-1440-7329; not 9807915762804490", "a"), (2, "und.34@mail7.example.com +1 (017) 555-7713 x (017) 555-7713 233.254.104.120 999.1.1.1 v1.2.3.4", "a"),
        (3, "2024-02-29 31.02.2024 28.02.2024 02/13/2020 13/02/2020 1999/12/31 078-05-1120 666-12-1234", "a"), (4, "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 078", "a"), (5, "4845168114407329 4845168114407329", "a"),
    ])
    got = texts(d)
    a, b, bad = re.fullmatch(r"card (\d{16}), again (\d{4}-\d{4}-\d{4}-\d{4}); not (\d+)", got[1]).groups()
    assert a == b.replace("-", "") and a != "4845168114407329" and luhn(a) and bad == "9807915762804490"
    assert got[5] == f"{a} {a}"  # linked across documents
    m = re.fullmatch(r"([a-z]{3})\.(\d\d)@mail7\.example\.com \+1 \((\d{3})\) (\d{3}-\d{4}) x \((\d{3})\) (\d{3}-\d{4}) (\S+) 999\.1\.1\.1 v1\.2\.3\.4", got[2])
    assert m and "555-7713" not in got[2] and m[3] == m[5] and m[4] == m[6]
    assert all(int(x) < 256 for x in m[7].split(".")) and m[7] != "233.254.104.120"
    p = got[3].split()
    assert p[1] == "31.02.2024" and p[7] == "666-12-1234" and re.fullmatch(r"\d\d\d-\d\d-\d{4}", p[6])
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", p[0]) and re.fullmatch(r"\d\d/\d\d/\d{4}", p[3]) and p[3][6:] == p[4][6:] and p[3][:2] == p[4][3:5]
    iban = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    m = re.fullmatch(r"(GB.. .... .... .... .... ..) and (DE.{20}) 078", got[4])
    assert iban(m[1].replace(" ", "")) == 1 and iban(m[2]) == 1 and m[2] != "DE89370400440532013000"


def test_is_a_permutation(spark):
    from pyspark.sql import functions as F

    n = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("s"))
    assert n.select(pii.permute_text(F.col("s"), "k", "t")).distinct().count() == 10_000
    days = spark.range(pii.SIDE**2).select(pii.permute_numbers(F.floor(F.col("id") / pii.SIDE), F.col("id") % pii.SIDE, pii.SIDE, "k", "d").alias("x"))
    assert days.distinct().count() == pii.SIDE**2


def test_keys_differ_and_clean_text_stays(documents):
    d = documents([(1, "4845168114407329", "a"), (2, "room 12, 3.5 kg, 2020", "a")])
    assert texts(d)[1] != texts(d, key="other")[1] and texts(d)[2] == "room 12, 3.5 kg, 2020"


def test_runs_on_into_further_groups(documents):
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    d = documents([
        (1, f"{card} 12/26", "a"), (2, "4111111111111111 123", "a"), (3, "4111111111111111-123", "a"), (4, f"{iban} 12 May", "a"), (5, f"{iban} 2024 x", "a"), (6, card, "a"), (7, iban, "a"),
        (8, f"😀 {card} 079-05-1120\n{card} 12.02.2024 a.b@c.de {card} 12/26\n", "a"), (9, "4111 1111 1111 1112 12/26 and ES92 2100 0418 4502 0005 1332 12 May", "a"),
    ])
    rows = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(d, "k").collect()}
    c, i = rows[6][0], rows[7][0]
    assert c != card and luhn(c) and i != iban
    assert rows[1] == (f"{c} 12/26", 1) and rows[2] == (c.replace(" ", "") + " 123", 1) and rows[3] == (c.replace(" ", "") + "-123", 1)
    assert rows[4] == (f"{i} 12 May", 1) and rows[5] == (f"{i} 2024 x", 1)
    m = re.fullmatch(r"😀 (.{19}) (\d{3}-\d\d-\d{4})\n(.{19}) (\d\d\.\d\d\.\d{4}) ([a-z]\.[a-z])@c\.de (.{19}) 12/26\n", rows[8][0])
    assert m and m[1] == m[3] == m[6] == c and m[2] != "079-05-1120" and m[4] != "12.02.2024" and rows[8][1] == 6
    assert rows[9] == ("4111 1111 1111 1112 12/26 and ES92 2100 0418 4502 0005 1332 12 May", 0)


def test_odd_documents(odd):
    got = pii.pseudonymise(odd, "k")
    assert set(got.columns) == set(odd.columns) and got.schema["n_replaced"].dataType.simpleString() == "int"
    same = lambda df: sorted(map(str, df.drop("n_replaced").select(sorted(set(odd.columns) - {"n_replaced"})).collect()))
    assert same(got) == same(odd) and pii.pseudonymise(odd.limit(0), "k").count() == 0


# A plain version: the same patterns tried in order at each place, checks and Feistel networks in Python.


def feistel(s, key, kind, classes):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, pii.ROUNDS + 1):
        h = hashlib.sha256(f"{key}/{kind}/{i}/{right}".encode()).hexdigest()
        new = ""
        for j, c in enumerate(left):
            by, code = int(h[j * 4 % 60 : j * 4 % 60 + 4], 16), ord(c)
            a, b = next(((a, b) for a, b in classes if a <= code <= b), (code, code))
            new += chr((code - a + by) % (b - a + 1) + a)
        left, right = right, new
    return left + right


def numbers(left, right, side, key, kind):
    for i in range(1, pii.ROUNDS + 1):
        f = int(hashlib.sha256(f"{key}/{kind}/{i}/{right}".encode()).hexdigest()[:12], 16)
        left, right = right, (left + f) % side
    return left, right


def refill(shape, new):
    it = iter(new)
    return "".join(next(it) if re.match("[0-9A-Z]", c) else c for c in shape)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def plain(kind, m, key):
    d = re.sub("[^0-9A-Z]", "", m)
    if kind == "email":
        name, at, host = m.partition("@")
        if re.search(r"[^\W_]", "".join(c for c in name if not any(a <= ord(c) <= b for a, b in pii.CLASSES))):
            return "x" + hashlib.sha256(f"{key}/name/{name}".encode()).hexdigest()[:16] + at + host
        return feistel(name, key, "email", pii.CLASSES) + at + host
    if kind == "iban":
        if mod97(d[4:] + d[:4]) != 1:
            return m
        body = feistel(d[4:], key, "iban", pii.CLASSES[:3])
        return refill(m, d[:2] + f"{98 - mod97(body + d[:2] + '00'):02}" + body)
    if kind == "ip":
        n = list(map(int, m.split(".")))
        if max(n) > 255:
            return m
        return ".".join(str(x) for h in numbers(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, key, "ip") for x in divmod(h, 256))
    if kind == "date":
        p = list(map(int, re.split("[-/.]", m)))
        form = "%Y-%m-%d" if "-" in m else "%Y/%m/%d" if re.match(r"\d{4}", m) else "%m/%d/%Y" if "/" in m and p[1] > 12 else "%d.%m.%Y" if "." in m else "%d/%m/%Y"
        try:
            nth = (datetime.datetime.strptime(m, form) - datetime.datetime(1900, 1, 1)).days
        except ValueError:
            return m
        if not 0 <= nth < pii.SIDE**2:
            return m
        a, b = numbers(*divmod(nth, pii.SIDE), pii.SIDE, key, "date")
        day = datetime.date(1900, 1, 1) + datetime.timedelta(a * pii.SIDE + b)
        return form.replace("%Y", f"{day.year:04}").replace("%m", f"{day.month:02}").replace("%d", f"{day.day:02}")
    if kind == "ssn":
        return m if m[:3] in ("000", "666") or m[0] == "9" or m[4:6] == "00" or m[7:] == "0000" else refill(m, feistel(d, key, "ssn", pii.CLASSES[:3]))
    if kind == "phone":
        lead = regex.match(rf"\+(?:{pii.COUNTRY})|", m)[0]
        return lead + refill(m[len(lead) :], feistel(re.sub("[^0-9]", "", m[len(lead) :]), key, "phone", pii.CLASSES[:3]))
    if not luhn(m):
        return m
    body = feistel(d[:-1], key, "card", pii.CLASSES[:3])
    return refill(m, next(body + c for c in "0123456789" if luhn(body + c)))


def test_against_a_plain_version(documents):
    rng = random.Random(6)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefXYZ0189._%+-") for _ in range(rng.randint(1, 30)))

    def card():
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), number(16)])

    makers = [
        lambda: f"{word()}x@{rng.choice(['a.de', 'mail.example.com'])}", lambda: f"{rng.choice(['李明', 'josé.é', 'Анна', 'ᚠᚢ', 'नमन', 'x' * 3000])}@example.com", lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: rng.choice(["{0}-{1:02}-{2:02}", "{0}/{1:02}/{2:02}", "{2:02}.{1:02}.{0}", "{2:02}/{1:02}/{0}", "{1:02}/{2:02}/{0}"]).format(rng.randint(1880, 2120), rng.randint(1, 12), rng.randint(1, 31)),
        lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: rng.choice(["+1 {0} {1} {2}", "+1{0}{1}{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "+49 {0} {1} {2}", "+353-{0}-{1}-{2}"]).format(number(3), number(3), number(4)), card,
        lambda: (lambda c, b: f"{c}{98 - mod97(b + c + '00') if rng.random() < 0.8 else 0:02}{b}")(rng.choice(["DE", "GB"]), number(18)), lambda: "plain words", lambda: number(rng.randint(1, 25)),
    ]
    texts = [" ; ".join(rng.choice(makers)() for _ in range(rng.randint(1, 8))) for _ in range(150)]
    whole = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()), regex.V1)
    want = {}
    for i, t in enumerate(texts):
        n = 0

        def swap(m):
            nonlocal n
            new = plain(m.lastgroup, m[0], "k")
            n += new != m[0]
            return new

        want[i] = (whole.sub(swap, t), n)
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(documents([(i, t, "s") for i, t in enumerate(texts)]), "k").collect()}
    assert got == want


def test_names_of_any_script_and_phones_in_any_form(documents):
    d = documents([(1, "李明@example.com josé.é@a.de ᚠᚢ@a.de " + "n" * 5000 + "@a.de", "a"), (2, "+15551234567|+1 555 123 4567|+1 (555) 123-4567|(555) 123-4567|555-123-4567", "a"), (3, "李明@example.com", "a")])
    rows = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(d, "k").collect()}
    names = [x.split("@")[0] for x in rows[1][0].split()]
    assert rows[1][1] == 4 and not set("李明é") & set(names[0] + names[1]) - set(names[1][3:5]) and "josé.é" not in rows[1][0] and "ᚠᚢ" not in rows[1][0] and names[3] != "n" * 5000
    assert rows[3] == (names[0] + "@example.com", 1) and all(0x4E00 <= ord(c) <= 0x9FA5 for c in names[0]) and len(names[0]) == 2
    phones = rows[2][0].split("|")
    assert rows[2][1] == 5 and phones[0].startswith("+1") and len({re.sub(r"\D", "", p)[-10:] for p in phones}) == 1 and "5551234567" not in phones[0]
