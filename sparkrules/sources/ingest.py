"""JSON input: lines, arrays, change-data envelopes and plain text, split into good and rejected records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IngestError
from ..plans.binding import HINTED
from ..plans.spec import ArrayAny, Leaf, Ruleset, WindowLeaf, fields_of, walk

#: Strings that stand for a missing value.
NULL_LIKE = ("", "NONE", "None", "none", "NULL", "null")
ERROR_MODES = ("skip_and_count", "dead_letter", "hard_fail")
#: What a value does that does not fit its field's type: become null, reject its record, or end the job.
TYPE_MODES = ("null", "dead_letter", "hard_fail")

#: What a family of operators needs of its field, strongest first where a field is used by several.
NEEDS = {
    "string": "string", "length": "string", "regex": "string", "cidr": "string", "temporal": "int64", "flags": "int64",
    "numeric": "float64", "range": "float64", "geo": "float64", "model": "float64", "vector": "float64", "arithmetic": "float64",
    "set": "array", "array_len": "array",
}
ORDER = ("entity_key", "string", "int64", "array", "float64", "categorical")


@dataclass
class Parsed:
    """good: the fields that rules use, and ``raw``-less; bad: (value, code, message)."""

    good: DataFrame
    bad: DataFrame


def _numeric_need(leaf: Leaf) -> str:
    return "float64" if leaf.args[0] is not None else "string"


def needs(ruleset: Ruleset) -> dict[str, str]:
    """Field to type: the hint's, else the strongest that the rules ask for."""
    found: dict[str, set[str]] = {}
    elements: dict[str, T.DataType] = {}
    for rule in ruleset.rules:
        for leaf in walk(rule.condition):
            if isinstance(leaf, ArrayAny):
                elements[leaf.path] = _merge(elements.get(leaf.path), _struct(_element_needs(leaf.where)))
                continue
            for f in fields_of(leaf):
                kind = NEEDS.get(leaf.family, "categorical")
                if leaf.family == "equal":
                    kind = _numeric_need(leaf)
                elif leaf.family == "cross":
                    kind = "float64" if leaf.op not in ("eq_field", "neq_field") else "categorical"
                elif isinstance(leaf, WindowLeaf):
                    kind = "entity_key" if f == leaf.entity else "float64"
                found.setdefault(f, set()).add(kind)
    out = {f: next(k for k in ORDER if k in kinds or (k == "string" and "string" in kinds)) for f, kinds in found.items()}
    out |= {n: h.type for n, h in ruleset.hints.items() if h.type and not (out.get(n) == "array" and h.type == "categorical")}
    return out | elements


def _element_needs(where) -> dict[str, str]:
    out: dict[str, str] = {}
    for leaf in walk(where):
        if isinstance(leaf, ArrayAny):
            continue
        for f in fields_of(leaf):
            kind = _numeric_need(leaf) if leaf.family == "equal" else NEEDS.get(leaf.family, "string")
            out[f] = kind if out.get(f, kind) == kind else "string"
    return out


def _type(kind) -> T.DataType:
    if isinstance(kind, T.DataType):
        return kind
    return T.ArrayType(T.StringType()) if kind == "array" else HINTED[kind][0]


def _struct(fields: dict) -> T.StructType:
    """Dotted names become nested structs."""
    tree: dict = {}
    for name, kind in fields.items():
        node = tree
        *path, last = name.split(".")
        for p in path:
            node = node.setdefault(p, {})
            if not isinstance(node, dict):
                break
        else:
            node[last] = kind
    build = lambda t: T.StructType([T.StructField(k, build(v) if isinstance(v, dict) else _type(v)) for k, v in t.items()])
    return build(tree)


def _merge(a: T.ArrayType | None, b: T.StructType) -> T.ArrayType:
    known = {f.name: f for f in (a.elementType.fields if a else [])}
    return T.ArrayType(T.StructType(list((known | {f.name: f for f in b.fields}).values())))


def schema_for(ruleset: Ruleset) -> T.StructType:
    return _struct(needs(ruleset))


def null_like(c: Column) -> Column:
    return F.when(~c.isin(list(NULL_LIKE)), c)


def _misfits(schema: T.StructType) -> Column:
    """Whether some single-valued field has a text in __text and nothing in __json."""
    out = F.lit(False)
    for f in schema.fields:
        if not isinstance(f.dataType, T.StructType | T.ArrayType | T.StringType):
            raw = F.col(f"__text.`{f.name}`")
            out = out | (F.col(f"__json.`{f.name}`").isNull() & null_like(raw).isNotNull())
    return out


def parse_json(lines: DataFrame, ruleset: Ruleset, value: str = "value", keep: tuple[str, ...] = (), mode: str = "skip_and_count", type_errors: str = "null") -> Parsed:
    """One JSON object a line, in a single pass, reading the fields that the rules name and no others.

    A line that does not begin with a whole JSON object is rejected; what follows the object in its line is not read, and blank lines
    are not records. In mode hard_fail the first rejected line ends the
    job. A top-level value that does not fit its field's type is null; with ``type_errors`` dead_letter its record is
    rejected as TYPE_MISMATCH, with hard_fail it ends the job.
    """
    if mode not in ERROR_MODES or type_errors not in TYPE_MODES:
        raise IngestError("INVALID_ENGINE_CONFIG", f"unknown error mode: {mode!r}, {type_errors!r}")
    schema = schema_for(ruleset)
    text = F.trim(F.col(value))
    full = lines.where(F.length(text) > 0)
    good = text.startswith("{") & F.try_parse_json(F.col(value)).isNotNull()
    if mode == "hard_fail":
        good = good | F.raise_error(F.concat(F.lit("MALFORMED_JSON: "), F.substring(F.col(value), 1, 80))).cast("boolean")
    keys = [f"`{k}`" for k in dict.fromkeys((*keep, value))]
    parsed = full.where(good).select(*keys, F.from_json(value, schema, {"mode": "PERMISSIVE"}).alias("__json"))
    bad = full.where(~good) if mode != "hard_fail" else full.limit(0)
    rejected = bad.select(*keys, F.lit("MALFORMED_JSON").alias("code"), F.lit("the line is not a JSON object; no field was read").alias("message"))
    if type_errors != "null":
        texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        parsed = parsed.withColumn("__text", F.from_json(value, texts)).withColumn("__wrong", _misfits(schema))
        if type_errors == "hard_fail":
            parsed = parsed.where(~F.col("__wrong") | F.raise_error(F.concat(F.lit("TYPE_MISMATCH: "), F.substring(F.col(value), 1, 80))).cast("boolean"))
        else:
            wrong = parsed.where("__wrong").select(*keys, F.lit("TYPE_MISMATCH").alias("code"), F.lit("a value does not fit its field's type").alias("message"))
            rejected, parsed = rejected.union(wrong), parsed.where(~F.col("__wrong"))
    columns = []
    for f in schema.fields:
        c = F.col(f"__json.`{f.name}`")
        columns.append((null_like(c) if isinstance(f.dataType, T.StringType) else c).alias(f.name))
    return Parsed(parsed.select(*[f"`{k}`" for k in keep], *columns), rejected)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, with the column value."""
    return spark.read.text(path)


def messages(spark: SparkSession, items: list[str]) -> DataFrame:
    return spark.createDataFrame([(m,) for m in items], "value string")


def json_array(documents: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, pos, value): the elements of documents that are JSON arrays, as lines."""
    return documents.select(*[f"`{k}`" for k in keep], F.posexplode(F.from_json(value, "array<string>")).alias("pos", "value"))


def json_array_files(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark.read.option("wholetext", True).text(path))


def unwrap_debezium(lines: DataFrame, value: str = "value", op_field: str = "__op") -> DataFrame:
    """Change events as flat objects: of a delete the state before, else the state after, with the operation in ``op_field``.

    Objects that are no envelopes pass as they are; an envelope without a state object is dropped. An envelope may stand
    inside ``payload``.
    """
    # a generator stands between the steps, so that each JSON text is parsed once and not in every place that reads a field of it
    envelope = "op string, before string, after string"
    names = ["op", "before", "after"]
    first = F.inline(F.array(F.from_json(value, f"payload string, {envelope}"))).alias("__payload", *[f"__{n}0" for n in names])
    second = F.inline(F.array(F.from_json("__payload", envelope))).alias(*[f"__{n}1" for n in names])
    df = lines.select("*", first).select("*", second)
    inside = F.col("__payload").isNotNull()
    op, before, after = (F.when(inside, F.col(f"__{n}1")).otherwise(F.col(f"__{n}0")) for n in names)
    state = F.when(op == "d", before).otherwise(after)
    # the operation's JSON form is taken from an array of one, without the brackets
    name = F.to_json(F.array(F.coalesce(op, F.lit("u"))))
    is_envelope = op.isNotNull() | before.isNotNull() | after.isNotNull()
    parts = F.array(F.struct(state.alias("__state"), name.alias("__name"), is_envelope.alias("__is")))
    df = df.select(*[f"`{c}`" for c in lines.columns], "__payload", F.inline(parts))
    body = F.trim(F.substr("__state", F.lit(2)))
    named = F.concat(F.lit('{"' + op_field + '":'), F.expr("substring(__name, 2, length(__name) - 2)"), F.when(body == "}", F.lit("")).otherwise(F.lit(",")), body)
    out = F.when(F.col("__is"), F.when(F.col("__state").startswith("{"), named)).otherwise(F.coalesce("__payload", value))
    return df.withColumn(value, out).drop("__payload", "__state", "__name", "__is").where(F.col(value).isNotNull())


def canonical_text(lines: DataFrame, source: str, service: str = "", instance: str = "", value: str = "value", now_ms: Column | None = None) -> DataFrame:
    """Lines that are no JSON objects are wrapped as log records."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    record = F.to_json(F.struct(now.alias("ts_ms"), F.lit(source).alias("source"), F.lit(service).alias("service"), F.lit(instance).alias("instance"), F.lit("INFO").alias("level"), F.col(value).alias("message")))
    return lines.withColumn(value, F.when(F.col(value).rlike(r"^\s*\{.*\}\s*$"), F.col(value)).otherwise(record))


def dead_letters(bad: DataFrame, source: str, value: str = "value") -> DataFrame:
    """Rejected records as rows for a dead-letter sink; all of them, not a sample."""
    return bad.select(F.unix_millis(F.current_timestamp()).alias("ts_ms"), "code", "message", F.lit(source).alias("source"), F.col(value).alias("payload"))
