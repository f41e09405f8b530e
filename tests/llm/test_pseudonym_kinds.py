"""Each kind of value against a brute-force network, in plain Python."""

import datetime
import hashlib
import re

import pytest

from veridex.llm.pii import BLOCK, KINDS, pseudonymise

SECRET = "k"
EPOCH = datetime.date(1800, 1, 1)


def feistel(tag, x, m1, m2):
    a, b = divmod(x, m2)
    f = lambda r, half: int(hashlib.sha256(f"{SECRET}|{tag}|{r}|{half}".encode()).hexdigest()[:15], 16)
    for r in range(1, 9):
        if r % 2 == 0:
            a = (a + f(r, b)) % m1
        else:
            b = (b + f(r, a)) % m2
    return a * m2 + b


def sequence(kind, q, alphabet):
    radix, out = len(alphabet), ""
    for i in range(0, len(q), BLOCK[radix]):
        p = q[i : i + BLOCK[radix]]
        x = 0
        for c in p:
            x = x * radix + alphabet.index(c)
        half = len(p) // 2
        y = feistel(f"{kind}{radix}:{len(q)}:{i // BLOCK[radix]}", x, radix**half, radix ** (len(p) - half))
        out += "".join(alphabet[y // radix ** (len(p) - j) % radix] for j in range(1, len(p) + 1))
    return out


def placed(m, cls, symbols):
    it = iter(symbols)
    return "".join(next(it) if re.match(cls, c) else c for c in m)


def digits(kind, m):
    return placed(m, "[0-9]", sequence(kind, re.sub("[^0-9]", "", m), "0123456789"))


def email(m):
    local, domain = m.split("@")
    for cls, alphabet in (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        local = placed(local, cls, sequence("email", "".join(c for c in local if re.match(cls, c)), alphabet))
    return f"{local}@{domain}"


def ip(m):
    x = 0
    for part in m.split("."):
        x = x * 256 + int(part)
    y = feistel("ip", x, 65536, 65536)
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


def date(m, layout):
    x = (datetime.datetime.strptime(m, layout).date() - EPOCH).days
    while True:
        x = feistel("date", x, 330, 330)
        d = EPOCH + datetime.timedelta(x)
        if layout != "%d/%m/%Y" or d.day > 12:
            return d.strftime(layout)


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    y = feistel("ssn", ((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 88902, 9999)
    area = y // 989901 + 1
    return f"{area + (area >= 666):03d}-{y // 9999 % 99 + 1:02d}-{y % 9999 + 1:04d}"


def card(m):
    body = sequence("card", re.sub("[^0-9]", "", m)[:-1], "0123456789")
    check = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return placed(m, "[0-9]", body + str(-check % 10))


def hexa(m):
    return sequence("hex", m, "0123456789ABCDEF" if re.search("[A-F]", m) else "0123456789abcdef")


CASES = {
    "jo.34@mail7.example.com": email("jo.34@mail7.example.com"), "Ab+C9_x@e-x.org": email("Ab+C9_x@e-x.org"), "a@b.co": email("a@b.co"),
    "97.51.17.173": ip("97.51.17.173"), "0.0.0.0": ip("0.0.0.0"), "255.255.255.255": ip("255.255.255.255"),
    "2020-02-29": date("2020-02-29", "%Y-%m-%d"), "31.12.1999": date("31.12.1999", "%d.%m.%Y"), "12/25/1999": date("12/25/1999", "%m/%d/%Y"), "05/06/2007": date("05/06/2007", "%m/%d/%Y"),
    "25/12/1999": date("25/12/1999", "%d/%m/%Y"), "31/01/1800": date("31/01/1800", "%d/%m/%Y"),
    "123-45-6789": ssn("123-45-6789"), "001-01-0001": ssn("001-01-0001"), "899-99-9999": ssn("899-99-9999"), "667-01-0001": ssn("667-01-0001"), "665-99-9999": ssn("665-99-9999"),
    "+1 (017) 555-7713": "+1 " + digits("phone", "(017) 555-7713"), "212-555-0100": digits("phone", "212-555-0100"), "+44 20 7946 0958": "+44" + digits("phone", " 20 7946 0958"),
    "+442079460958": "+44" + digits("phone", "2079460958"), "01 23 45 67 89": "01" + digits("phone", " 23 45 67 89"), "+49 (30) 1234567": "+49" + digits("phone", " (30) 1234567"),
    "4111111111111111": card("4111111111111111"), "4111-1111-1111-1111": card("4111-1111-1111-1111"), "3782 822463 10005": card("3782 822463 10005"), "378282246310005": card("378282246310005"),
    "e51a5499e3950eabef3742d6cf40b27b4e61a74a": hexa("e51a5499e3950eabef3742d6cf40b27b4e61a74a"), "E51A5499E3950EABEF3742D6CF40B27B4E61A74A0": hexa("E51A5499E3950EABEF3742D6CF40B27B4E61A74A0"),
}
STAY = ["256.1.1.1", "31/31/1999", "30.02.2001", "1799-12-31", "000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000", "4111111111111112", "3782 822463 10006", "+12345", "e51a5499", "1.2.3.4.5", "x" * 40]


@pytest.fixture(scope="module")
def found(spark):
    rows = list(enumerate([*CASES, *STAY, " and ".join(CASES), None, ""]))
    return pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), SECRET).orderBy("doc_id").collect()


def test_values(found):
    assert {v: r["text"] for v, r in zip(CASES, found, strict=False)} == CASES
    for v, r in zip(CASES, found, strict=False):
        (one,) = r["found"]
        assert one["value"] == r["text"] and re.fullmatch(KINDS[one["kind"]], one["value"]), v


def test_what_fails_its_test_stays(found):
    rest = found[len(CASES) : len(CASES) + len(STAY)]
    assert [r["text"] for r in rest] == STAY and not any(r["found"] for r in rest)


def test_values_within_a_text(found):
    assert found[-3]["text"] == " and ".join(CASES.values()) and len(found[-3]["found"]) == len(CASES)
    assert found[-2]["text"] is None and found[-1]["text"] == "" and found[-1]["found"] == found[-2]["found"] == []
