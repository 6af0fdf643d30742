"""JSON payloads to typed rows.

One payload is one request body: a JSON object or an array of objects. A payload
is taken whole or not at all; a payload that is not taken stays visible with the
reason in ``status``:

``ok``             every element fits the signal's columns
``empty``          ``[]`` or ``null``
``invalid_json``   not JSON, or a field of the wrong type or range
``bad_timestamp``  an element without ``timestamp``
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_uuid, content_id, is_uuid
from ..functions.times import is_rfc3339, parse_rfc3339
from ..session import written
from ..signals import NIL_UUID, SIGNALS, SPARK_TYPES, U32_MAX, U64_MAX, Signal, zero_value

# Worst element decides the status of its payload, so order matters.
STATUSES = ("ok", "bad_timestamp", "invalid_json")
OK, BAD_TIMESTAMP, INVALID = range(3)


def read_payloads(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    whole_files: bool = False,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
    spread: bool = False,
) -> DataFrame:
    """Payload texts as (payload_id, source, value), one per line or one per file.

    The id is a hash of file path and text, so reading again gives it again. Equal
    lines of one file share it until ``number_copies`` has told them apart: done here
    for a batch, and per micro-batch by ``ingest`` (a file is never split over two).
    A compressed file is read by one task; with ``spread`` lines are dealt out to all of them first.
    """
    reader = (spark.readStream if streaming else spark.read).format("text").option("wholetext", whole_files)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if streaming and max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    text = reader.load(path).select("value", F.col("_metadata.file_path").alias("source"))
    if spread:
        text = text.hint("rebalance", "value")
    read = text.select(content_id(F.col("source"), F.col("value")).alias("payload_id"), "source", "value")
    return read if streaming or whole_files else number_copies(read)


def number_copies(payloads: DataFrame, named: Column | None = None) -> DataFrame:
    """Give equal lines of one file ids of their own, the same set of ids on every reading.

    The first keeps its id, the n-th gets a hash of it and n. Ids are counted
    first, so payloads move only where they repeat, and copies of one line meet
    in a partial aggregate: a file of equal lines makes no large task. The count
    runs at once. Takes any table with ``payload_id`` in which equal ids mean
    equal rows. With ``named`` only rows that it holds for are counted and numbered.
    """
    others = None
    if named is not None:
        everything, named = payloads, F.coalesce(named, F.lit(True))
        payloads, others = everything.filter(named), everything.filter(~named)
    counts = payloads.groupBy("payload_id").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    counts = written(counts, "payload-copies")
    if counts.isEmpty():
        return payloads if others is None else everything
    alone = payloads.join(counts, "payload_id", "left_anti")
    repeated = payloads.join(counts, "payload_id").dropDuplicates(["payload_id"])
    numbered = repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    own = F.when(F.col("_copy") == 1, F.col("payload_id")).otherwise(content_id(F.col("payload_id"), F.col("_copy")))
    told_apart = alone.unionByName(numbered.withColumn("payload_id", own).select(*payloads.columns))
    return told_apart if others is None else told_apart.unionByName(others)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# JSON readers that take standard JSON only.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# How a field is read as a typed value. Its JSON type is judged apart, because a
# typed reader turns a number into text and ``"1"`` into 1 without a word.
_READ_AS = {
    "text": "string", "uuid": "string", "time": "string", "time?": "string", "u32": "bigint", "u64": "decimal(20,0)",
    "double": "double", "doubles": "array<double>", "u64s": "array<decimal(20,0)>", "labels": "map<string,string>",
}


def _present(x: Column, t: Column, raw: Column, kind: str) -> Column:
    """Status and value of a field that is there: ``t`` its JSON type, ``raw`` as the typed reader saw it."""

    def read(status: Column, value: Column) -> Column:
        return F.struct(status.alias("status"), value.cast(SPARK_TYPES[kind]).alias("value"))

    is_text = t == "STRING"
    if kind == "text":
        return read(F.when(is_text, OK).otherwise(INVALID), raw)
    if kind == "uuid":
        return read(F.when(is_text & is_uuid(raw), OK).otherwise(INVALID), canonical_uuid(raw))
    if kind in ("time", "time?"):
        return _let(
            F.when(is_text & is_rfc3339(raw), parse_rfc3339(raw)),
            lambda at: read(F.when(at.isNotNull(), OK).otherwise(INVALID), at),
        )
    if kind in ("u32", "u64"):
        return read(_unsigned_status(t, raw, U32_MAX if kind == "u32" else U64_MAX), raw)
    if kind == "double":
        return read(_number_status(t, raw), raw)
    if kind in ("doubles", "u64s"):
        # One bad item makes the typed list NULL, so items are judged one by one.
        items = F.try_variant_get(x, "$", "array<variant>")

        def item_status(y: Column, k: Column) -> Column:
            if kind == "doubles":
                return _number_status(k, F.try_variant_get(y, "$", "double"))
            return _unsigned_status(k, F.try_variant_get(y, "$", "decimal(20,0)"), U64_MAX)

        codes = F.transform(
            items,
            lambda y: _let(
                F.schema_of_variant(y),
                lambda k: F.when(k.isNull() | (k == "VOID"), OK).otherwise(item_status(y, k)),
            ),
        )
        zero = F.lit(0.0) if kind == "doubles" else zero_value("u64")
        worst = F.when(items.isNull(), INVALID).otherwise(F.coalesce(F.array_max(codes), F.lit(OK)))
        return read(worst, F.transform(raw, lambda r: F.coalesce(r, zero)))
    if kind == "labels":
        return _let(F.try_variant_get(x, "$", "map<string,variant>"), lambda m: read(_labels_status(m), _labels(x, m, raw)))
    raise ValueError(f"unknown column kind {kind!r}")


def _number_status(t: Column, raw: Column) -> Column:
    finite = F.abs(raw) < F.lit(float("inf"))
    return F.when((t == "BIGINT") | t.startswith("DECIMAL") | ((t == "DOUBLE") & finite), OK).otherwise(INVALID)


def _unsigned_status(t: Column, raw: Column, limit: int) -> Column:
    bound = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    if limit <= U32_MAX:
        return F.when((t == "BIGINT") & raw.between(0, limit), OK).otherwise(INVALID)
    # Whole numbers too large for a bigint read as decimals; so do 1.0 and the like, which are no integers.
    wide = t.rlike(r"^DECIMAL\(\d+,0\)$") & raw.between(bound(2**63), bound(limit))
    return F.when(((t == "BIGINT") & (raw >= 0)) | wide, OK).otherwise(INVALID)


def _labels_status(labels: Column) -> Column:
    kinds = F.transform(F.map_values(labels), lambda v: F.schema_of_variant(v))
    texts = F.forall(kinds, lambda k: k.isNull() | k.isin("STRING", "VOID"))
    return F.when(texts, OK).otherwise(INVALID)


def _labels(x: Column, labels: Column, raw: Column) -> Column:
    """Label map without NULLs; the typed reader keeps repeated keys, the last of which counts."""
    unique = F.when(F.size(labels) == F.size(raw), raw).otherwise(F.try_variant_get(x, "$", "map<string,string>"))
    return F.transform_values(unique, lambda _, v: F.coalesce(v, F.lit("")))


def _field(x: Column, raw: Column, kind: str) -> Column:
    """Struct (status, value) of one field of one element."""
    absent = F.struct(
        F.lit(BAD_TIMESTAMP if kind == "time" else OK).alias("status"), zero_value(kind).alias("value")
    )
    return _let(
        F.schema_of_variant(x),
        lambda t: F.when(t.isNull() | (t == "VOID"), absent).otherwise(_present(x, t, raw, kind)),
    )


def _element(kinds: Column, typed: Column, signal: Signal) -> Column:
    """Struct (status, row) of one element, read twice: as untyped fields and as typed ones."""
    names = list(signal.wire_columns)
    fields = F.struct(*[_field(kinds[n], typed[n], k).alias(n) for n, k in signal.wire_columns.items()])
    return _let(
        fields,
        lambda read: F.struct(
            # An element that is null instead of an object.
            F.when(kinds.isNull(), INVALID).otherwise(F.greatest(*[read[n]["status"] for n in names])).alias("status"),
            F.struct(*[read[n]["value"].alias(n) for n in names]).alias("row"),
        ),
    )


# Types under which the typed reader tells the truth, by kind. An absent or null field has none or VOID.
_NUMBER = r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"
_PLAIN_TYPES = {
    "text": "STRING", "uuid": "STRING", "time": "STRING", "time?": "STRING", "u32": "BIGINT",
    # A whole number beyond a bigint, if its text shows no fraction (``_maybe_fraction``).
    "u64": r"(?:BIGINT|DECIMAL\((?:19|20),0\))", "double": _NUMBER,
    "doubles": f"ARRAY<(?:{_NUMBER}|VOID)>", "u64s": "ARRAY<(?:BIGINT|VOID)>",
    "labels": r"OBJECT<(?:`?[A-Za-z0-9_.\-]++`?: (?:STRING|VOID)(?:, )?+)*+>",
}


def plain_signature(signal: Signal) -> str:
    """Pattern of the type signatures of payloads whose every field has its kind's plain type.

    A signature is the merged type of a payload's elements, one short text for a whole
    payload, of which a producer sends few different ones. Unknown keys, keys in another
    case, mixed types and integers of over 20 digits do not match.
    """
    # A signature has its keys in order, so each field is looked for once, at its place.
    fields = "".join(f"(?:{n}: (?:{_PLAIN_TYPES[k]}|VOID)(?:, )?+)?+" for n, k in sorted(signal.wire_columns.items()))
    return f"^(?:ARRAY<)?+OBJECT<{fields}>{{1,2}}$"


# JSON as a text has it. Nothing here ever goes back over what it took, so a long text costs no more than its length.
_WS = r"[ \t\r\n]*+"
_STRING = r'"(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}))*+"'
_WHOLE = r"(?:0|[1-9][0-9]{0,17}+)"
_DECIMAL = rf"-?+{_WHOLE}(?:\.[0-9]{{1,18}}+)?+(?:[eE][+-]?+[0-9]{{1,2}}+)?+"
# How deep lists and objects may lie in an unknown key's value for its text to be plain.
_UNKNOWN_DEPTH = 4


def _listed(item: str, opened: str, closed: str) -> str:
    """Items between brackets, with a comma before every item but the first."""
    return rf"{opened}{_WS}(?:{item}{_WS}(?:,{_WS}(?!{closed})|(?={closed})))*+{closed}"


def _any_value() -> str:
    value = rf"(?:{_STRING}|{_DECIMAL}|true|false|null"
    nested = value + ")"
    for _ in range(_UNKNOWN_DEPTH):
        nested = value + "|" + _listed(nested, r"\[", r"\]") + "|" + _listed(rf"{_STRING}{_WS}:{_WS}{nested}", r"\{", r"\}") + ")"
    return nested


# A value of each kind whose text says what its type signature would.
_PLAIN_TEXTS = {
    "text": _STRING, "uuid": _STRING, "time": _STRING, "time?": _STRING, "u32": _WHOLE,
    # 20 digits fit the typed reader; a value beyond 64 bits is judged there.
    "u64": r"(?:0|[1-9][0-9]{0,19}+)", "double": _DECIMAL,
    "doubles": _listed(f"(?:{_DECIMAL}|null)", r"\[", r"\]"), "u64s": _listed(f"(?:{_WHOLE}|null)", r"\[", r"\]"),
    "labels": _listed(rf"{_STRING}{_WS}:{_WS}(?:{_STRING}|null)", r"\{", r"\}"),
}


def plain_text(signal: Signal) -> str:
    """Pattern of payload texts whose every known field is written as its kind's plain type.

    It answers what the type signature would, without a second parse, and for texts with
    unknown keys as well. A known key in another case, a key with an escape, and any number or
    text that readers might take differently do not match; those payloads are looked at by type.
    """
    wire = signal.wire_columns
    by_kind = {k: "|".join(n for n, kind in wire.items() if kind == k) for k in dict.fromkeys(wire.values())}
    known = "|".join(rf'(?:{names})"{_WS}:{_WS}(?:{_PLAIN_TEXTS[k]}|null)' for k, names in by_kind.items())
    unknown = rf'(?!(?i:{"|".join(wire)})")[ !#-\[\]-~]*+"{_WS}:{_WS}{_any_value()}'
    element = _listed(rf'"(?:{known}|{unknown})', r"\{", r"\}")
    return rf"\A{_WS}(?:{element}|\[{_WS}(?=\{{)(?:{element}{_WS}(?:,{_WS}(?=\{{)|(?=\])))++\]){_WS}\z"


def _last_of_each(labels: Column) -> Column:
    """A map in which the last of repeated keys counts; maps without them stay as they are."""
    keys = F.array_distinct(F.map_keys(labels))
    entries = F.map_entries(labels)
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    unique = F.when(F.size(keys) == F.size(labels), labels).otherwise(F.map_from_arrays(keys, last))
    holes = F.exists(F.map_values(unique), lambda v: v.isNull())
    return F.when(holes, F.transform_values(unique, lambda _, v: F.coalesce(v, F.lit("")))).otherwise(unique)


def _plain_element(t: Column, signal: Signal) -> Column:
    """Struct (status, row) of one typed element of a payload with a plain signature: only values are judged."""
    wire = signal.wire_columns
    zero = lambda kind: zero_value(kind).cast(SPARK_TYPES[kind])
    ok = lambda good: F.when(F.coalesce(good, F.lit(True)), OK).otherwise(INVALID)
    finite = lambda x: F.abs(x) < F.lit(float("inf"))
    read = {n: F.when(is_rfc3339(t[n]), parse_rfc3339(t[n])) for n, k in wire.items() if k in ("time", "time?")}

    def judged(at: Column) -> Column:
        checks, values = [F.when(t.isNull(), INVALID).otherwise(OK)], []
        for n, kind in wire.items():
            raw, value = t[n], None
            if kind in ("time", "time?"):
                value = at[n]
                absent = BAD_TIMESTAMP if kind == "time" else OK
                checks.append(F.when(raw.isNull(), absent).when(value.isNull(), INVALID).otherwise(OK))
            elif kind == "uuid":
                checks.append(ok(is_uuid(raw)))
                value = F.coalesce(canonical_uuid(raw), zero(kind))
            elif kind in ("u32", "u64"):
                checks.append(ok(raw.between(0, U32_MAX) if kind == "u32" else (raw >= 0) & (raw <= F.lit(str(U64_MAX)).cast("decimal(20,0)"))))
            elif kind == "double":
                checks.append(ok(finite(raw)))
            elif kind in ("doubles", "u64s"):
                item = zero("double" if kind == "doubles" else "u64")
                checks.append(ok(F.forall(raw, lambda x: F.coalesce(finite(x) if kind == "doubles" else x >= 0, F.lit(True)))))
                value = F.coalesce(F.transform(raw, lambda x: F.coalesce(x, item)), zero(kind))
            elif kind == "labels":
                value = F.coalesce(_last_of_each(raw), zero(kind))
            values.append((F.coalesce(raw, zero(kind)) if value is None else value).cast(SPARK_TYPES[kind]).alias(n))
        return F.struct(F.greatest(F.lit(OK), *checks).alias("status"), F.struct(*values).alias("row"))

    return _let(F.struct(*[c.alias(n) for n, c in read.items()]), judged)


def _maybe_other_case(value: Column) -> Column:
    """Whether a text may hold a key with a capital letter or an escape: cheap, and never wrong when it says no."""
    capital = value.rlike(r'"[a-z0-9_]*+[A-Z][A-Za-z0-9_]*+"[ \t\r\n]*:')
    return capital | (value.contains("\\u") & value.rlike(r'\\u[^"]*"[ \t\r\n]*:'))


def _maybe_fraction(value: Column, signal: Signal) -> Column:
    """Whether a whole-number field may be written as 1.0 or 1e3, which a wide integer beside it would hide in the
    payload's type: cheap, and never wrong when it says no."""
    names = "|".join(n for n, k in signal.wire_columns.items() if k == "u64")
    if not names:
        return F.lit(False)
    return value.contains("\\u") | value.rlike(rf'"(?:{names})"[ \t\r\n]*+:[ \t\r\n]*+-?+[0-9]*+[.eE]')


def _any_case(signal: Signal) -> Column:
    """Elements of a payload with a known key in another case, else NULL.

    A key counts whatever its case; of several the last one.
    """
    wire = signal.wire_columns
    listed = F.from_json("value", "array<map<string,variant>>", _STRICT)
    alone = F.from_json("value", "map<string,variant>", _STRICT)
    elements = F.coalesce(listed, _let(alone, lambda m: F.when(m.isNotNull(), F.array(m))))

    def other_case(key: Column) -> Column:
        return F.lower(key).isin(*wire) & ~key.isin(*wire)

    def of(entries: Column, name: str) -> Column:
        found = F.filter(entries, lambda e: F.lower(e["key"]) == name)
        return _let(found, lambda f: F.get(f, F.size(f) - 1)["value"])

    def element(m: Column) -> Column:
        def judged(kinds: Column) -> Column:
            typed = F.struct(*[F.try_variant_get(kinds[n], "$", _READ_AS[k]).alias(n) for n, k in wire.items()])
            return _let(typed, lambda t: _element(kinds, t, signal))

        read = _let(F.map_entries(m), lambda entries: F.struct(*[of(entries, n).alias(n) for n in wire]))
        return _let(F.when(m.isNotNull(), read), judged)

    return _let(
        elements,
        lambda es: F.when(F.exists(es, lambda m: F.exists(F.map_keys(m), other_case)), F.transform(es, element)),
    )


def decode(payloads: DataFrame, signal: str) -> DataFrame:
    """One row per payload: payload_id, source, value, signal, status, n_rows, elements.

    ``elements`` holds a (status, row) struct per element, rows typed. A lone
    object reads as a list of one; keys match in any case.
    """
    spec = SIGNALS[signal]
    wire = spec.wire_columns
    untyped = F.from_json("value", "array<struct<" + ",".join(f"`{n}`: variant" for n in wire) + ">>", _STRICT)
    typed = F.from_json("value", "array<struct<" + ",".join(f"`{n}`: {_READ_AS[k]}" for n, k in wire.items()) + ">>", _STRICT)

    def judge(elements: Column) -> Column:
        worst = F.array_max(F.transform(elements, lambda e: e["status"]))
        status = (
            F.when(F.size(elements) == 0, "empty")
            .when(elements.isNotNull(), F.element_at(F.array(*[F.lit(s) for s in STATUSES]), worst + 1))
            .when(F.col("value").rlike(r"^[ \t\r\n]*null(?![A-Za-z0-9_])"), "empty")
            .otherwise("invalid_json")
        )
        return F.struct(status.alias("status"), F.coalesce(F.size(elements), F.lit(0)).alias("n_rows"), elements.alias("elements"))

    # inline() keeps the result of the one reading: filters on status cannot be
    # moved below it and repeat the work.
    # One look at the text, or else at the whole type, settles the types of all fields of nearly
    # every payload; the others are judged field by field.
    def is_plain(whole: Column) -> Column:
        wide = lambda s: s.contains("DECIMAL(") & _maybe_fraction(F.col("value"), spec)
        return _let(F.schema_of_variant(whole), lambda s: s.rlike(plain_signature(spec)) & ~wide(s))

    def read(rows: Column) -> Column:
        other_case = _maybe_other_case(F.col("value"))
        by_type = F.transform(rows, lambda t: _plain_element(t, spec))

        def look_again(fields: Column) -> Column:
            # The types of the known keys alone: unknown ones are left out.
            exact = F.zip_with(fields, rows, lambda u, t: _element(u, t, spec))
            by_field = F.coalesce(F.when(other_case, _any_case(spec)), exact)
            return F.when(~other_case & is_plain(F.to_variant_object(fields)), by_type).otherwise(by_field)

        return F.when(F.col("value").rlike(plain_text(spec)), by_type).otherwise(_let(untyped, look_again))

    elements = _let(typed, read)
    judged = F.transform(F.array(elements), judge)
    return payloads.select(
        "payload_id", "source", "value", F.lit(signal).alias("signal"), F.inline(judged)
    )


def accepted_rows(decoded: DataFrame, signal: str) -> DataFrame:
    """Typed rows of the payloads that were taken, ids filled in."""
    spec = SIGNALS[signal]
    taken = decoded.select("payload_id", F.posexplode(F.when(F.col("status") == "ok", F.col("elements"))).alias("_pos", "_e"))
    return fill_ids(taken.select("payload_id", "_pos", "_e.row.*"), signal).select(*spec.columns)


def fill_ids(rows: DataFrame, signal: str) -> DataFrame:
    """Give a row its id where the producer sent none.

    Incident and trigger ids are filled when nil, log ids always. The id comes
    from (payload id, position), so a replayed batch gets the same ids. The
    incident a trigger points to is never filled.
    """
    spec = SIGNALS[signal]
    if spec.generated_id is None:
        return rows
    made = content_id(F.lit(signal), F.col("payload_id"), F.col("_pos"))
    if not spec.id_on_wire:
        return rows.withColumn(spec.generated_id, made)
    given = F.col(spec.generated_id)
    return rows.withColumn(spec.generated_id, F.when(given == NIL_UUID, made).otherwise(given))


def shows_payload_id(signal: str) -> Column:
    """Whether anything made of a decoded payload names its id: a row without an id of its own, or its record if it is set aside."""
    made, set_aside = SIGNALS[signal].generated_id, F.col("status") != "ok"
    if made is None or not SIGNALS[signal].id_on_wire:
        return set_aside | F.lit(made is not None)
    return set_aside | F.exists("elements", lambda e: e["row"][made] == NIL_UUID)


def rejected_payloads(decoded: DataFrame) -> DataFrame:
    """Payloads that were not taken, with the reason and the whole text."""
    return decoded.filter("status <> 'ok'").select("signal", "payload_id", "source", "status", "n_rows", "value")


def payload_counts(decoded: DataFrame) -> DataFrame:
    """Rows accepted and rejected per payload."""
    ok = F.col("status") == "ok"
    return decoded.select(
        "signal",
        "payload_id",
        "status",
        F.when(ok, F.col("n_rows")).otherwise(0).cast("bigint").alias("accepted"),
        F.when(ok, 0).otherwise(F.col("n_rows")).cast("bigint").alias("rejected"),
    )


def ingest_health(*decoded: DataFrame) -> DataFrame:
    """Payloads and rows per signal and status over several decoded signals."""
    parts = [d.select("signal", "status", "n_rows") for d in decoded]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("signal", "status").agg(
        F.count(F.lit(1)).alias("payloads"), F.sum("n_rows").cast("bigint").alias("n_rows")
    )


def encode(rows: DataFrame, signal: str) -> DataFrame:
    """Add each row's JSON text as ``json``, the inverse of decoding one object."""
    spec = SIGNALS[signal]
    fields = [
        F.date_format(F.col(n), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias(n) if k in ("time", "time?") else F.col(n)
        for n, k in spec.wire_columns.items()
    ]
    return rows.withColumn("json", F.to_json(F.struct(*fields)))
