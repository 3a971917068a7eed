"""Record loading against a character-by-character reader."""

import re

from sluicelog.operators import intake
from sluicelog.plans import problems


def brute_fields(line):
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, out = i + 1, []
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                out.append(line[i:j])
                if line[j + 1 : j + 2] == '"':
                    out.append('"')
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < n and line[i] != ",":
                return None
            fields.append("".join(out))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            fields.append(line[i:j])
            i = j
        if i >= n:
            return fields
        i += 1


def brute_reason(line):
    if line is None:
        return "columns"
    fields = brute_fields(line)
    if fields is None:
        return "quoting"
    if len(fields) != 19:
        return "columns"
    host, length, status = fields[7], fields[17], fields[18]
    label = r"[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    if host != "-" and not (1 <= len(host) <= 253 and all(re.fullmatch(label, x) for x in host.split("."))):
        return "host"
    if length != "-" and not (re.fullmatch("[0-9]+", length) and int(length) < 2**63):
        return "response_body_len"
    if status != "-" and not (re.fullmatch("[0-9]{3}", status) and 100 <= int(status) <= 599):
        return "status_code"
    return None


def test_against_brute_force(spark, sf_dir):
    lines = {r.line_id: r.line for r in problems.table(spark, sf_dir, "http_lines").collect()}
    want = {k: r for k, v in lines.items() if (r := brute_reason(v))}
    got = problems.p5_found(spark, sf_dir).collect()
    assert {r.line_id: r.reason for r in got} == want and len(got) == len(want)
    good = {r.line_id: r for r in problems.p5_rows(spark, sf_dir).collect()}
    assert set(good) == set(lines) - set(want)
    for k, r in good.items():
        fields = [None if x == "-" else x for x in brute_fields(lines[k])]
        assert r.host == fields[7] and r.user_agent == fields[10] and r.status_code == (fields[18] and int(fields[18]))


def record(**changed):
    fields = {i: "x" for i in range(19)} | {7: "a.example", 17: "10", 18: "200"} | {int(k[1:]): v for k, v in changed.items()}
    return ",".join(fields[i] for i in range(19))


CASES = [
    None, "", ",", '"', '""', '"""', '""""', record(), record(f0='""'), record(f0='"a,b"'), record(f0='"a""b"'), record(f0='"a"b'), record(f0='a"b'), record(f0='"""a"""'), record(f18='"200"'), record(f18='"200" '),
    record(f0='"a\nb"'), record(f0='"\x1a,\x1a1"'), record(f0="\x1a0"), record(f7="-"), record(f7=""), record(f7="a..b"), record(f7="a."), record(f7="-a"), record(f7="a-"), record(f7="a" * 64), record(f7=".".join(["a" * 63] * 4)),
    record(f7=".".join(["a" * 63] * 3 + ["a" * 61])), record(f7="a_b"), record(f7="é.fr"), record(f7="a\n"), record(f17="-1"), record(f17=""), record(f17="9223372036854775807"), record(f17="9223372036854775808"),
    record(f17="0" * 30 + "7"), record(f17="٣"), record(f17=" 7"), record(f18="99"), record(f18="600"), record(f18="0200"), record(f18="2e2"), record(f18="-"), record(f7="a..b", f17="x", f18="x"), record(f17="x", f18="x"),
    record(f0="y" * 300_000), '"' + '""' * 20_000 + '",' + record(), "," * 50_000, '"a",' * 18 + '"200"', record(f0='"-"'),
]


def test_cases(spark):
    rows = [(i if i % 5 else None, x, i) for i, x in enumerate(CASES)]
    df = spark.createDataFrame([*rows, *rows], "line_id long, line string, reason int")
    loader = intake.Intake(df, "line_id", "line", intake.HTTP_FIELDS, intake.HTTP_RULES)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    want = sorted([(i, r) for i, x, _ in rows if (r := brute_reason(x))] * 2, key=key)
    assert sorted([tuple(r) for r in loader.rejected().collect()], key=key) == want
    good = loader.accepted().collect()
    assert len(good) == 2 * sum(brute_reason(x) is None for x in CASES)
    want_first = sorted((brute_fields(x)[0] if brute_fields(x)[0] != "-" else None) or "" for x in CASES if brute_reason(x) is None)
    assert sorted((r.c_ip or "") for r in good)[::2] == want_first


def test_empty(spark):
    loader = intake.Intake(spark.createDataFrame([], "line_id long, line string"), "line_id", "line", intake.HTTP_FIELDS, intake.HTTP_RULES)
    assert loader.rejected().count() == 0 and loader.accepted().count() == 0
