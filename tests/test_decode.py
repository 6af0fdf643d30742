"""Payload decoding: statuses, typed values, filled ids."""

import random
import string
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanloom.signals import NIL_UUID, SIGNALS
from spanloom.sources import payloads

T = '"timestamp":"2023-03-05T17:45:00Z"'
AT = datetime(2023, 3, 5, 17, 45)

LOG = """{"timestamp": "2023-03-05T17:45:00Z", "trace_id": "7f3e90", "span_id": "9d", "service_name": "ledger",
 "severity": "ERROR", "env": "lab", "k8s_cluster": "north-4", "k8s_namespace_name": "books", "k8s_resource_name": "ledger-77",
 "instrumentation_library_name": "tracekit", "instrumentation_library_version": "0.9", "body": "posting refused",
 "attributes": {"account": "A-17"}}"""
INCIDENT = f'{{{T}, "service_name": "ledger", "title": "postings stuck", "severity": "low", "status": "open", "resolved_at": null}}'

# (signal, payload, status, rows)
CORPUS = [
    ("logs", LOG, "ok", 1),
    ("ai_spans", f'{{{T}, "prompt_tokens": 31, "completion_tokens": 9, "total_tokens": 40, "cost_usd": 0.00017}}', "ok", 1),
    ("incidents", INCIDENT, "ok", 1),
    ("incidents", INCIDENT.replace("{", f'{{"incident_id": "{NIL_UUID}", ', 1), "ok", 1),
    ("alert_triggers", f'{{{T},"status":"firing"}}', "ok", 1),
    ("traces", f'[{{{T},"span_id":"a"}},{{{T},"span_id":"b"}}]', "ok", 2),
    ("traces", f' \n\t[{{{T},"span_id":"a"}},{{{T},"span_id":"b"}}]', "ok", 2),
    ("metrics", f'{{{T},"metric_name":"m"}}', "ok", 1),
    ("traces", "[]", "empty", 0),
    ("traces", "null", "empty", 0),
    ("traces", " null ", "empty", 0),
    ("traces", "nullx", "invalid_json", 0),
    ("traces", "[null]", "invalid_json", 0),
    ("traces", f"[{{{T}}},null]", "invalid_json", 0),
    ("traces", "5", "invalid_json", 0),
    ("traces", '"str"', "invalid_json", 0),
    ("traces", "[1]", "invalid_json", 0),
    ("traces", "", "invalid_json", 0),
    ("traces", "{bad", "invalid_json", 0),
    ("traces", f'[{{{T}}},{{{T}}}', "invalid_json", 0),
    ("traces", f"{{{T},'span_id':'a'}}", "invalid_json", 0),
    ("traces", f'{{{T},"duration_ns":"12"}}', "invalid_json", 0),
    ("traces", f'{{{T},"duration_ns":1.5}}', "invalid_json", 0),
    ("traces", f'{{{T},"duration_ns":1.0}}', "invalid_json", 0),
    ("traces", f'{{{T},"duration_ns":1e3}}', "invalid_json", 0),
    ("traces", f'{{{T},"duration_ns":-1}}', "invalid_json", 0),
    ("traces", f'{{{T},"duration_ns":9223372036854775807}}', "ok", 1),
    ("traces", f'{{{T},"duration_ns":9223372036854775808}}', "ok", 1),
    ("traces", f'{{{T},"duration_ns":18446744073709551615}}', "ok", 1),
    ("traces", f'[{{{T},"span_id":"a"}},{{{T},"duration_ns":18446744073709551615}},{{{T},"span_id":"b"}}]', "ok", 3),
    ("traces", f'[{{{T},"Duration_NS":18446744073709551615}},{{{T},"duration_ns":18446744073709551616}}]', "invalid_json", 0),
    ("traces", f'{{{T},"duration_ns":18446744073709551616}}', "invalid_json", 0),
    ("traces", f'{{{T},"service_name":5}}', "invalid_json", 0),
    ("traces", f'{{{T},"service_name":true}}', "invalid_json", 0),
    ("traces", f'{{{T},"service_name":{{"a":"b"}}}}', "invalid_json", 0),
    ("traces", f'[{{{T},"span_id":"a"}},{{{T},"span_id":7}}]', "invalid_json", 0),
    ("traces", f'{{{T},"span_id":"a","span_id":"b"}}', "ok", 1),
    ("traces", f'{{{T},"unknown":1}}', "ok", 1),
    ("traces", f'{{{T},"attributes":{{"k":null}}}}', "ok", 1),
    ("traces", f'{{{T},"attributes":{{"k":"1","k":"2"}}}}', "ok", 1),
    ("traces", f'{{{T},"attributes":{{"k":5}}}}', "invalid_json", 0),
    ("traces", f'{{{T},"attributes":["k"]}}', "invalid_json", 0),
    ("metrics", f'{{{T},"bucket_bounds":[1,2.5,1e3]}}', "ok", 1),
    ("metrics", f'{{{T},"bucket_bounds":[1,"x"]}}', "invalid_json", 0),
    ("metrics", f'{{{T},"bucket_bounds":{{"a":1}}}}', "invalid_json", 0),
    ("metrics", f'{{{T},"bucket_bounds":null,"bucket_counts":[1,null]}}', "ok", 1),
    ("metrics", f'{{{T},"bucket_counts":[1,2.0]}}', "invalid_json", 0),
    ("metrics", f'{{{T},"bucket_counts":[1,18446744073709551615]}}', "ok", 1),
    ("metrics", f'{{{T},"bucket_counts":[1,18446744073709551616]}}', "invalid_json", 0),
    ("metrics", f'{{{T},"count":18446744073709551615}}', "ok", 1),
    ("metrics", f'{{{T},"value":1e400}}', "invalid_json", 0),
    ("metrics", f'{{{T},"value":NaN}}', "invalid_json", 0),
    ("metrics", f'{{{T},"value":7}}', "ok", 1),
    ("traces", f"{{{T}}} trailing", "ok", 1),
    ("traces", '{"timestamp":"2026-08-26 10:00"}', "invalid_json", 0),
    ("traces", '{"timestamp":"2026-13-26T10:00:00Z"}', "invalid_json", 0),
    ("traces", '{"timestamp":"2026-02-30T10:00:00Z"}', "invalid_json", 0),
    ("traces", '{"timestamp":"2026-08-26T10:00:00"}', "invalid_json", 0),
    ("traces", '{"timestamp":1756202400}', "invalid_json", 0),
    ("traces", '{"timestamp":"2026-08-26T10:00:00.123456789+02:00"}', "ok", 1),
    ("traces", '{"span_id":"a"}', "bad_timestamp", 0),
    ("traces", "{}", "bad_timestamp", 0),
    ("traces", '{"timestamp":null}', "bad_timestamp", 0),
    ("traces", '[{"span_id":"a"},{"span_id":1}]', "invalid_json", 0),
    ("ai_spans", f'{{{T},"prompt_tokens":4294967295}}', "ok", 1),
    ("ai_spans", f'{{{T},"prompt_tokens":4294967296}}', "invalid_json", 0),
    ("incidents", f'{{{T},"incident_id":"not-a-uuid"}}', "invalid_json", 0),
    ("incidents", f'{{{T},"incident_id":""}}', "invalid_json", 0),
    ("incidents", f'{{{T},"incident_id":"6BA7B8109DAD11D180B400C04FD430C8"}}', "ok", 1),
    ("traces", f'{{{T},"Service_Name":"x","SPAN_ID":"s"}}', "ok", 1),
    ("traces", f'{{{T},"Duration_Ns":"12"}}', "invalid_json", 0),
    ("traces", '{"Timestamp":"2023-03-05T17:45:00Z"}', "ok", 1),
    ("traces", f'[{{{T}}},{{{T},"Span_Id":7}}]', "invalid_json", 0),
    ("traces", f'{{{T},"attributes":{{"Service_Name":"x"}}}}', "ok", 1),
    ("traces", f'{{{T},"unknown":[1,{{"Service_Name":2}}],"other":null}}', "ok", 1),
    ("metrics", f'{{{T},"bucket_bounds":[1,1e400]}}', "invalid_json", 0),
    ("metrics", f'{{{T},"bucket_counts":[1,-1]}}', "invalid_json", 0),
]


def _payloads(spark, texts):
    rows = [(f"p{n}", "test", t) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "payload_id string, source string, value string")


def _rows(spark, signal, text):
    return payloads.accepted_rows(payloads.decode(_payloads(spark, [text]), signal), signal).collect()


@pytest.mark.parametrize("signal", list(SIGNALS))
def test_corpus(spark, signal):
    cases = [c for c in CORPUS if c[0] == signal]
    decoded = payloads.decode(_payloads(spark, [c[1] for c in cases]), signal)
    counts = {r["payload_id"]: (r["status"], r["accepted"]) for r in payloads.payload_counts(decoded).collect()}
    for n, (_, text, status, rows) in enumerate(cases):
        assert counts[f"p{n}"] == (status, rows), text
    assert payloads.accepted_rows(decoded, signal).count() == sum(c[3] for c in cases)
    kept = {r["payload_id"]: r["value"] for r in payloads.rejected_payloads(decoded).collect()}
    assert kept == {f"p{n}": c[1] for n, c in enumerate(cases) if c[2] != "ok"}


def test_values(spark):
    log = _rows(spark, "logs", LOG)[0]
    assert log["attributes"] == {"account": "A-17"} and log["timestamp"] == AT and len(log["log_id"]) == 36

    incident = _rows(spark, "incidents", INCIDENT)[0]
    assert incident["resolved_at"] is None and incident["incident_id"] != NIL_UUID and incident["labels"] == {}

    trigger = _rows(spark, "alert_triggers", f'{{{T},"status":"firing"}}')[0]
    assert trigger["incident_id"] == NIL_UUID and trigger["trigger_id"] != NIL_UUID

    metric = _rows(spark, "metrics", f'{{{T},"bucket_bounds":[1,2.5,1e3],"bucket_counts":[1,null]}}')[0]
    assert metric["bucket_bounds"] == [1.0, 2.5, 1000.0] and metric["bucket_counts"] == [1, 0]
    assert (metric["quantiles"], metric["labels"], metric["value"], metric["metric_name"]) == ([], {}, 0.0, "")

    assert _rows(spark, "traces", f'{{{T},"span_id":"a","span_id":"b"}}')[0]["span_id"] == "b"
    assert _rows(spark, "traces", f'{{{T},"attributes":{{"k":"1","k":"2"}}}}')[0]["attributes"] == {"k": "2"}
    assert _rows(spark, "traces", f'{{{T},"attributes":{{"k":null}}}}')[0]["attributes"] == {"k": ""}
    moved = _rows(spark, "traces", '{"timestamp":"2026-08-26T10:00:00.123956789+02:00"}')[0]
    assert moved["timestamp"] == datetime(2026, 8, 26, 8, 0, 0, 123000)
    bare = _rows(spark, "incidents", f'{{{T},"incident_id":"6BA7B8109DAD11D180B400C04FD430C8"}}')[0]
    assert bare["incident_id"] == "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def test_keys_match_in_any_case(spark):
    span = _rows(spark, "traces", f'{{{T},"span_id":"a","Service_Name":"x","SPAN_ID":"s","attributes":{{"Span_Id":"kept"}}}}')[0]
    assert (span["span_id"], span["service_name"], span["attributes"]) == ("s", "x", {"Span_Id": "kept"})
    assert span["timestamp"] == AT and span["duration_ns"] == 0


def test_generated_ids_are_stable_and_distinct(spark):
    text = f"[{{{T}}},{{{T}}}]"
    first = [r["log_id"] for r in _rows(spark, "logs", text)]
    assert first == [r["log_id"] for r in _rows(spark, "logs", text)] and len(set(first)) == 2


def test_random_rows_survive_a_round_trip(spark):
    rng = random.Random(7)

    def word():
        return "".join(rng.choice(string.printable + "äß漢😀") for _ in range(rng.randint(0, 12)))

    def value(kind):
        return {
            "text": word, "time": lambda: datetime(2024, 1, rng.randint(1, 28), rng.randint(0, 23), 0, 0, rng.randint(0, 999) * 1000),
            "u64": lambda: Decimal(rng.choice([rng.randint(0, 2**64 - 1), 2**64 - 1, 2**63, rng.randint(0, 10**6)])), "u32": lambda: rng.randint(0, 2**32 - 1),
            "double": lambda: rng.choice([0.0, rng.uniform(-1e9, 1e9), rng.random() * 1e-9]),
            "doubles": lambda: [rng.uniform(-5, 5) for _ in range(rng.randint(0, 4))],
            "u64s": lambda: [Decimal(rng.randint(0, 2**64 - 1)) for _ in range(rng.randint(0, 4))],
            "labels": lambda: {word(): word() for _ in range(rng.randint(0, 3))},
        }[kind]()

    for signal in ("traces", "metrics", "ai_spans"):
        spec = SIGNALS[signal]
        rows = [tuple(value(k) for k in spec.columns.values()) for _ in range(60)]
        sent = spark.createDataFrame(rows, spec.schema)
        texts = payloads.encode(sent, signal).select(
            F.md5("json").alias("payload_id"), F.lit("t").alias("source"), F.col("json").alias("value")
        )
        back = payloads.accepted_rows(payloads.decode(texts, signal), signal)
        assert sorted(map(repr, back.collect())) == sorted(map(repr, sent.collect()))


def test_files_of_lines_and_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(f"{{{T}}}\n[{{{T}}}, {{{T}}}]\n{{bad\n", encoding="utf-8")
    lines = payloads.decode(payloads.read_payloads(spark, str(tmp_path)), "traces")
    assert sorted((r["status"], r["n_rows"]) for r in lines.collect()) == [("invalid_json", 0), ("invalid_json", 0), ("ok", 1)]
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "b.json").write_text(LOG)
    assert payloads.decode(payloads.read_payloads(spark, str(whole), whole_files=True), "logs").first()["status"] == "ok"


def test_wide_integers_and_unknown_keys_take_the_short_way_and_give_the_same(spark, monkeypatch):
    """Integers beyond a bigint and unknown keys are judged by type signature, with what judging by field gives."""
    t = '"timestamp":"2024-01-10T12:00:00Z"'
    wide, extra = f'"duration_ns":{2**64 - 1}', '"extra":{"deep":[1,{"x":null}]},"note":"?"'
    short = [
        f"{{{t},{wide}}}", f'[{{{t},"duration_ns":5}},{{{t},{wide}}}]', f'{{{t},"duration_ns":{2**63}}}', f'{{{t},"duration_ns":{2**64}}}',
        f'{{{t},"duration_ns":{-2**63 - 1}}}', f"{{{extra},{t}}}", f"[{{{t}}},{{{extra},{t},{wide}}}]", f'{{"time":"x","span_id":"a"}}',
        f'[{{{t}}},null,{{{extra},{t}}}]', f'{{{extra},{t},"duration_ns":-1}}', f'{{{extra},{t},"attributes":{{"a":"1","a":"2","b":null}}}}',
    ]
    long = [
        f'[{{{t},"duration_ns":1.0}},{{{t},{wide}}}]', f'[{{{t},"duration_ns" : 1e3}},{{{t},{wide}}}]', f'[{{{t},"duration\\u005fns":1.0}},{{{t},{wide}}}]',
        f'{{{t},"duration_ns":{10**25}}}', f'{{{t},"duration_ns":{10**40}}}', f'{{{t},"duration_ns":1.0}}', f'{{{extra},{t},"span_id":7}}',
        f'{{{extra},{t},"Span_Id":"s"}}', f'{{{extra},{t},"duration_ns":"5"}}', f'{{{extra},{t},"attributes":{{"a":[1]}}}}', f'{{"a":1,"a":2,{t}}} x', f"[[{{{t}}}]]",
        f'{{{extra},{t}', f'{{"extra":NaN,{t}}}', f'{{"a":\'b\',{t}}}', f'{{{t},"duration_ns":12345678901234567890.0}}', f'{{{t},"duration_ns":0.5}}',
    ]
    sent = spark.createDataFrame([(f"p{n}", "t", v) for n, v in enumerate(short + long)], "payload_id string, source string, value string")

    def outcome(rows=sent):
        decoded = payloads.decode(rows, "traces")
        return sorted(map(repr, payloads.payload_counts(decoded).collect())), sorted(map(repr, payloads.accepted_rows(decoded, "traces").collect()))

    got = outcome()
    monkeypatch.setattr(payloads, "plain_signature", lambda spec: "^never$")
    assert got == outcome()
    monkeypatch.undo()
    # Judging by field marks nothing here: those payloads never come to it.
    monkeypatch.setattr(payloads, "_element", lambda kinds, typed, spec: F.struct(F.lit(payloads.INVALID).alias("status"), payloads._plain_element(typed, spec)["row"].alias("row")))
    first = sent.filter(F.expr(f"int(substring(payload_id, 2)) < {len(short)}"))
    monkeypatch.setattr(payloads, "_any_case", lambda spec: F.lit(None))
    statuses = {r["payload_id"]: r["status"] for r in payloads.decode(first, "traces").collect()}
    assert [statuses[f"p{n}"] for n in (0, 1, 2, 5, 6, 10)] == ["ok"] * 6 and statuses["p7"] == "bad_timestamp"


def test_plain_texts_are_settled_without_a_second_parse_and_alike(spark, monkeypatch):
    """What a payload's text settles, unknown keys and wide integers included, is what judging field by field gives."""
    rng = random.Random(11)
    t = '"timestamp":"2024-01-10T12:00:00Z"'

    def space():
        return rng.choice(["", "", "", " ", "\t", "\n "])

    def listed(items, a, b):
        text = f"{space()},{space()}".join(items)
        return f"{a}{space()}{text}{rng.choice([''] * 20 + [','])}{space()}{b}"

    texts = ['"a"', '""', '"q\\"\\\\\\/\\n"', '"\\u00e4"', '"\\ud83d\\ude00"', '"\\ud83d"', '"\\x"', '"ä漢😀"', '"{[,:"', '"a\nb"']
    numbers = ["0", "-0", "7", "-7", "07", "1.0", "1.", ".5", "1e3", "1E+2", "1e400", "+1", "999999999999999999", str(2**63 - 1), str(2**63),
               str(2**64 - 1), str(2**64), str(10**20), str(10**40), "0." + "1" * 30, "NaN", "4294967295", "4294967296"]
    times = ['"2024-01-10T12:00:00Z"', '"2024-02-30T00:00:00Z"', '"x"', '"2024-01-10T12:00:00.1234+02:00"']

    def value(depth):
        kind = rng.randint(0, 9)
        if depth and kind == 0:
            return listed([value(depth - 1) for _ in range(rng.randint(0, 3))], "[", "]")
        if depth and kind == 1:
            return listed([f"{rng.choice(texts[:4])}:{value(depth - 1)}" for _ in range(rng.randint(0, 3))], "{", "}")
        return rng.choice([rng.choice(texts), rng.choice(numbers), "null", "true", "false", rng.choice(times), "nul", "'a'"])

    def right(kind):
        if kind in ("time", "time?"):
            return rng.choice(times)
        if kind in ("u32", "u64", "double"):
            return rng.choice(numbers)
        if kind in ("doubles", "u64s"):
            return listed([rng.choice([*numbers, "null"]) for _ in range(rng.randint(0, 2))], "[", "]")
        if kind == "labels":
            return listed([f"{rng.choice([x for x in texts if 'ud83d' not in x])}{space()}:{rng.choice([*texts, 'null'])}" for _ in range(rng.randint(0, 2))], "{", "}")
        return rng.choice(texts)

    def element(wire):
        members = [t] if rng.random() < 0.9 else []
        for _ in range(rng.randint(0, 3)):
            name = rng.choice([*wire, "extra", "Extra", "note-ä", "span\\u005fid", rng.choice(list(wire)).upper()])
            said = right(wire[name]) if name in wire and rng.random() < 0.9 else value(rng.choice([1, 2, 7]))
            members.append(f'"{name}"{space()}:{space()}{said}')
        rng.shuffle(members)
        return listed(members, "{", "}")

    def payload(wire):
        if rng.random() < 0.5:
            return space() + element(wire) + rng.choice([""] * 20 + [" ", " x", "}", ",{}"])
        return listed([element(wire) for _ in range(rng.randint(1, 3))], "[", "]")

    for signal in ("traces", "metrics", "incidents"):
        wire = SIGNALS[signal].wire_columns
        made = [payload(wire) for _ in range(500)]
        sent = spark.createDataFrame([(f"p{n}", "t", v) for n, v in enumerate(made)], "payload_id string, source string, value string").cache()
        settled = sent.select(F.count_if(F.col("value").rlike(payloads.plain_text(SIGNALS[signal])))).first()[0]
        assert 60 < settled < 440

        def outcome():
            decoded = payloads.decode(sent, signal)
            return sorted(map(repr, payloads.payload_counts(decoded).collect())), sorted(map(repr, payloads.accepted_rows(decoded, signal).collect()))

        got = outcome()
        monkeypatch.setattr(payloads, "plain_signature", lambda spec: "^never$")
        monkeypatch.setattr(payloads, "plain_text", lambda spec: "^never$")
        assert got == outcome()
        monkeypatch.undo()
        sent.unpersist()

    # Neither types nor single fields are looked at for these.
    monkeypatch.setattr(payloads, "plain_signature", lambda spec: "^never$")
    monkeypatch.setattr(payloads, "_element", lambda kinds, typed, spec: F.struct(F.lit(payloads.INVALID).alias("status"), payloads._plain_element(typed, spec)["row"].alias("row")))
    monkeypatch.setattr(payloads, "_any_case", lambda spec: F.lit(None))
    plain = [f'{{"extra":{{"deep":[1,{{"x":null}}]}},"Note":"?",{t}}}', f'[{{{t}}}, {{{t},"duration_ns":{2**64 - 1}}}]', f'{{{t},"attributes":{{"Host":"\\"a\\""}}}}',
             "[" + ",".join([f'{{{t},"operation_name":"{"x" * 50}"}}'] * 20_000) + "]", f'{{{t},"operation_name":"{"x" * 3_000_000}"}}']
    sent = spark.createDataFrame([("p", "t", v) for v in plain], "payload_id string, source string, value string")
    assert [r["status"] for r in payloads.decode(sent, "traces").select("status").collect()] == ["ok"] * len(plain)
