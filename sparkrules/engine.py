"""The rule engine: a ruleset becomes one lazy plan over a DataFrame."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError, SchemaError
from .functions.predicates import Scope, compile_condition, compile_leaf, for_filter, key_of
from .functions.vectors import array_similarity, similarity
from .operators import decide
from .operators.lookups import Lookup, join_lookup, load_lookup, make_lookup
from .operators.windows import NULL_VALUE, add_windows
from .paths import modified, read_text
from .plans import parser
from .plans.binding import Schema, divided
from .plans.conflict import ConflictReport, analyze
from .plans.spec import ModelLeaf, Ruleset, VectorLeaf, WindowLeaf, fields_of, walk

#: Wide rulesets are evaluated this many rules a projection, which keeps generated methods small.
RULES_PER_STAGE = 100


@dataclass(frozen=True)
class EngineConfig:
    """missing_model: "error" refuses rules whose model is not registered, "zero" scores them 0.

    window_precision: "float" compares sums, averages and the like of windows as 32-bit numbers, as the surveyed engine does,
    "double" as they are computed.
    """

    output_columns: tuple[str, ...] | None = None
    null_window_value: float = NULL_VALUE
    missing_model: str = "error"
    window_precision: str = "float"
    fill_defaults: bool = False

    def __post_init__(self):
        if self.missing_model not in ("error", "zero"):
            raise ConfigError("INVALID_ENGINE_CONFIG", f"missing_model: {self.missing_model!r}")
        if self.window_precision not in ("float", "double"):
            raise ConfigError("INVALID_ENGINE_CONFIG", f"window_precision: {self.window_precision!r}")


@dataclass
class ReloadStatus:
    """What has become of the rules file: how often it was read again, and why the last try failed, if it did."""

    path: str = ""
    modified: float = 0.0
    version: str = ""
    reloads: int = 0
    failures: int = 0
    last_error: str = ""


class RuleEngine:
    """Holds one ruleset at a time; loading a new one replaces it whole, and a failed load changes nothing."""

    def __init__(self, config: EngineConfig | None = None):
        self.config = config or EngineConfig()
        self.ruleset: Ruleset | None = None
        self.lookups: dict[str, Lookup] = {}
        self.models: dict[str, object] = {}
        self.status = ReloadStatus()
        self._spark: SparkSession | None = None

    @property
    def last_error(self) -> str:
        return self.status.last_error

    def load_rules(self, path: str, spark: SparkSession | None = None) -> RuleEngine:
        """A local file, or, given a session, any path that Spark reads (such as s3a://...); lookups beside it are read alike."""
        at = modified(path, spark)
        read = (lambda p: read_text(p, spark)) if spark and "://" in path else None
        self._install(parser.parse_file(path, read), read)
        self._spark = spark
        self.status = replace(self.status, path=path, modified=at, version=self.ruleset.version, last_error="")
        return self

    def load_rules_from_string(self, text: str, base_dir: str = ".") -> RuleEngine:
        self._install(parser.parse_string(text, base_dir))
        return self

    def load_rules_from_dict(self, root: dict, base_dir: str = ".") -> RuleEngine:
        self._install(parser.parse_ruleset(root, base_dir))
        return self

    def _install(self, ruleset: Ruleset, read=None) -> None:
        lookups = {s.name: load_lookup(s, ruleset.base_dir, read) for s in ruleset.lookups}
        for rule in ruleset.rules:
            for leaf in walk(rule.condition):
                if leaf.family == "lookup" and leaf.args[0] not in lookups and leaf.args[0] not in self.lookups:
                    raise SchemaError("UNKNOWN_FIELD_NAME", f"unknown lookup: '{leaf.args[0]}'", rule_id=rule.id)
        self.ruleset, self.lookups = ruleset, self.lookups | lookups

    def register_lookup(self, name: str, kind: str, values: list) -> None:
        """A lookup without a file; rules loaded later may use it."""
        self.lookups[name] = make_lookup(name, kind, [str(v) for v in values])

    def register_model(self, name: str, model) -> None:
        """model.column(features) gives the score: LinearModel, OnnxModel or any object of that shape."""
        self.models[name] = model

    def reload_if_changed(self) -> bool:
        """Loads the rules file again, by the way it was first read, when it has changed.

        On an error the old rules stay, ``status`` says why, and the file is tried again when it changes once more.
        """
        if not self.status.path or not (at := modified(self.status.path, self._spark)) or at == self.status.modified:
            return False
        try:
            self.load_rules(self.status.path, self._spark)
            self.status.reloads += 1
            return True
        except Exception as e:  # noqa: BLE001  whatever is wrong with the new file, the old rules stay
            self.status.modified, self.status.last_error = at, str(e)
            self.status.failures += 1
            return False

    def analyze_conflicts(self) -> ConflictReport:
        return analyze(self._rules())

    def _rules(self) -> Ruleset:
        if self.ruleset is None:
            raise ConfigError("INVALID_ENGINE_CONFIG", "no rules are loaded")
        return self.ruleset

    def evaluate(self, df: DataFrame, as_of_ms: int | None = None, clock: Column | str | None = None) -> Evaluation:
        """clock: epoch seconds of each row's micro-batch, or a field with its time; needed by windows only."""
        return Evaluation(self, df, int(time.time() * 1000) if as_of_ms is None else as_of_ms, clock)

    def evaluate_ndjson(self, lines: DataFrame, **kwargs) -> Evaluation:
        """lines: a column ``value`` with one JSON object each. Lines that are no JSON objects are in ``Evaluation.rejected``."""
        from .sources.ingest import parse_json

        parsed = parse_json(lines, self._rules())
        engine = self._filling()
        out = engine.evaluate(parsed.good, **kwargs)
        out.rejected = parsed.bad
        return out

    def _filling(self) -> RuleEngine:
        other = RuleEngine(replace(self.config, fill_defaults=True))
        other.ruleset, other.lookups, other.models = self.ruleset, self.lookups, self.models
        return other


class Evaluation:
    """One ruleset over one DataFrame. Each output is a lazy DataFrame that computes what it needs, and no more."""

    rejected: DataFrame | None = None
    #: (df, schema, leaves, names) -> df with the window columns; by default they are computed over df itself.
    window_source = None

    def __init__(self, engine: RuleEngine, df: DataFrame, as_of_ms: int, clock: Column | str | None):
        self.engine, self.ruleset, self.source, self.as_of_ms, self.clock = engine, engine._rules(), df, as_of_ms, clock
        self.registry = decide.Registry.of(self.ruleset)
        self.schema = Schema(df.schema, self.ruleset.hints, engine.config.fill_defaults)
        self._validate()

    @property
    def rules(self):
        return self.ruleset.rules

    def _scope(self, rule_id: str = "", derived: dict | None = None) -> Scope:
        return Scope(lambda n: self.schema.resolve(n, rule_id), rule_id, self.as_of_ms, derived or {}, self.engine.lookups, window_precision=self.engine.config.window_precision)

    def _validate(self) -> None:
        """Compiles every rule against the schema, so that errors come before any job.

        Equal leaves are one predicate; rules become trees over the predicates' columns.
        """
        self._leaves: dict = {}
        self._names: dict = {}
        self._fires: list[Column] = []
        placeholders = {}
        for rule in self.rules:
            for leaf in walk(rule.condition):
                if isinstance(leaf, WindowLeaf | ModelLeaf | VectorLeaf):
                    placeholders[key_of(leaf)] = F.lit(0)
                if isinstance(leaf, WindowLeaf) and self.clock is None:
                    raise SchemaError("MISSING_REQUIRED_FIELD", "windows need a clock", rule_id=rule.id)
                if isinstance(leaf, ModelLeaf) and leaf.model not in self.engine.models and self.engine.config.missing_model == "error":
                    raise SchemaError("UNKNOWN_FIELD_NAME", f"model '{leaf.model}' is not registered", rule_id=rule.id)
                if isinstance(leaf, VectorLeaf) and len(leaf.dims) > 1 and len(leaf.dims) != len(leaf.reference):
                    raise SchemaError("TYPE_MISMATCH", "vector_distance: dims and reference differ in length", rule_id=rule.id)
                for f in fields_of(leaf):
                    self.schema.resolve(f, rule.id)
            scope = self._scope(rule.id, placeholders)

            def note(leaf, scope=scope):
                if leaf not in self._leaves:
                    self._leaves[leaf] = compile_leaf(leaf, scope)
                    self._names[leaf] = f"__p{len(self._names)}"
                return F.col(self._names[leaf])

            self._fires.append(compile_condition(rule.condition, scope, note))

    @cached_property
    def _derived(self) -> tuple[DataFrame, dict]:
        """The source with a column for each distinct window, model, vector and large lookup."""
        df, found = self.source, {}
        windows: dict[tuple, WindowLeaf] = {}
        columns: dict[str, Column] = {}
        for leaf in self._leaves:
            if isinstance(leaf, WindowLeaf):
                windows[key_of(leaf)] = leaf
            elif isinstance(leaf, ModelLeaf | VectorLeaf) and key_of(leaf) not in found:
                name = f"__d{len(found)}"
                found[key_of(leaf)] = F.col(name)
                columns[name] = self._model(leaf) if isinstance(leaf, ModelLeaf) else self._vector(leaf)
            elif leaf.family == "lookup" and not self.engine.lookups[leaf.args[0]].inline:
                key = ("lookup", leaf.fields[0], leaf.args[0])
                if key not in found:
                    name = f"__d{len(found)}"
                    df = join_lookup(df, self.schema, leaf, self.engine.lookups[leaf.args[0]], name)
                    found[key] = F.col(name)
        if windows:
            names = {k: f"__w{i}" for i, k in enumerate(windows)}
            if self.window_source is not None:
                df = self.window_source(df, self.schema, windows, names)
            else:
                df = add_windows(df, self.schema, windows, self._clock(), names, self.engine.config.null_window_value, self.engine.config.window_precision)
            found |= {k: F.col(n) for k, n in names.items()}
        return (df.withColumns(columns) if columns else df), found

    def _clock(self) -> Column:
        if isinstance(self.clock, str):
            return divided(self.schema.resolve(self.clock).column.cast("bigint"), 1000)
        return self.clock.cast("bigint")

    def _model(self, leaf: ModelLeaf) -> Column:
        model = self.engine.models.get(leaf.model)
        return F.lit(0.0).cast("float") if model is None else model.column([self.schema.resolve(f).column for f in leaf.features])

    def _vector(self, leaf: VectorLeaf) -> Column:
        first = self.schema.resolve(leaf.dims[0])
        if len(leaf.dims) == 1 and first.array:
            return array_similarity(leaf.metric, first.column, leaf.reference)
        return similarity(leaf.metric, [self.schema.resolve(d).column for d in leaf.dims], leaf.reference)

    def _fired(self, more: dict[str, Column] | None = None) -> DataFrame:
        """Source columns, ``more``, and a boolean __r{i} for each rule. Distinct predicates are computed once, in a projection of their own."""
        df, derived = self._derived
        own = [c for c in self.source.columns]
        predicates = []
        for leaf, column in self._leaves.items():
            late = isinstance(leaf, WindowLeaf | ModelLeaf | VectorLeaf) or leaf.family == "lookup"
            predicates.append((compile_leaf(leaf, self._scope(derived=derived)) if late else column).alias(self._names[leaf]))
        extra = [c.alias(name) for name, c in (more or {}).items()]
        stage = df.select(*[f"`{c}`" for c in own], *extra, *predicates)
        return stage.select(*[f"`{c}`" for c in own], *[f"`{name}`" for name in more or {}], *[c.alias(f"__r{i}") for i, c in enumerate(self._fires)])

    @cached_property
    def fired(self) -> DataFrame:
        return self._fired()

    @property
    def _keep(self) -> list[str]:
        kept = self.engine.config.output_columns
        return [f"`{c}`" for c in (self.source.columns if kept is None else kept)]

    def _pairs(self) -> list:
        return [(r, F.col(f"__r{i}")) for i, r in enumerate(self.rules)]

    @property
    def matched(self) -> Column:
        return reduce(or_, (F.col(f"__r{i}") for i in range(len(self.rules))), F.lit(False))

    def _code(self, rule: Column) -> Column:
        """The decision code of a winning rule's index."""
        codes = [0, *(self.registry.labels.index(r.label) for r in self.rules)]
        return F.element_at(F.from_json(F.lit(json.dumps(codes)), "array<int>"), rule + 2)

    def codes(self, more: dict[str, Column] | None = None) -> DataFrame:
        """The kept columns with matched, decision_code, score and winning_rule (index, -1: none), and ``more`` derived ones."""
        won = decide.winner(self._pairs(), self.registry, self.ruleset.default_decision)
        fired = self._fired(more) if more else self.fired
        names = [f"`{name}`" for name in more or {}]
        staged = fired.select(*self._keep, self.matched.alias("matched"), decide.score(self._pairs()).alias("score"), won.alias("winning_rule"), *names)
        return staged.select(*self._keep, "matched", self._code(F.col("winning_rule")).alias("decision_code"), "score", "winning_rule", *names)

    def model_scores(self) -> dict[str, Column]:
        """model.<name> for each model of the rules, over the columns of ``fired``."""
        derived = self._derived[1]
        return {f"model.{leaf.model}": derived[key_of(leaf)] for leaf in self._leaves if isinstance(leaf, ModelLeaf)}

    def decisions(self, more: dict[str, Column] | None = None) -> DataFrame:
        """The kept columns with matched, decision, score, risk_band and winning_rule_id ("" without a winner), and ``more`` derived ones."""
        labels = F.array(*[F.lit(x) for x in self.registry.labels])
        ids = F.from_json(F.lit(json.dumps(["", *(r.id for r in self.rules)])), "array<string>")
        named = self.codes(more).withColumn("decision", F.element_at(labels, F.col("decision_code") + 1))
        return named.select(
            *self._keep,
            "matched",
            "decision",
            "score",
            decide.risk_band(F.col("decision"), F.col("score")).alias("risk_band"),
            F.element_at(ids, F.col("winning_rule") + 2).alias("winning_rule_id"),
            *[f"`{name}`" for name in more or {}],
        )

    def bitmasks(self) -> DataFrame:
        """The kept columns with a boolean rule_<id> for each rule."""
        return self.fired.select(*self._keep, *[F.col(f"__r{i}").alias(f"rule_{r.id}") for i, r in enumerate(self.rules)])

    def packed_bitmasks(self, bits: int = 63) -> DataFrame:
        """The kept columns with mask_0, mask_1, ...: ``bits`` rules each, the first rule in the lowest bit."""
        masks = []
        for at in range(0, len(self.rules), bits):
            parts = [F.when(F.col(f"__r{i}"), F.lit(1 << (i - at)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(at, min(at + bits, len(self.rules)))]
            masks.append(reduce(lambda a, b: a.bitwiseOR(b), parts).alias(f"mask_{at // bits}"))
        return self.fired.select(*self._keep, *masks)

    def explanations(self) -> DataFrame:
        """decisions() with the ids and the reason codes of all rules that fired."""
        ids = F.array_compact(F.array(*[F.when(c, F.lit(r.id)) for r, c in self._pairs()]))
        reasons = F.array_compact(F.array(*[F.when(c, F.lit(r.reason_code)) for r, c in self._pairs()]))
        won = decide.winner(self._pairs(), self.registry, self.ruleset.default_decision)
        labels = F.array(*[F.lit(x) for x in self.registry.labels])
        return self.fired.select(*self._keep, F.element_at(labels, self._code(won) + 1).alias("decision"), ids.alias("rules"), reasons.alias("reasons"))

    def rule_counts(self) -> DataFrame:
        """(rule_id, matches), in rule order; shadow rules are counted as well."""
        if not self.rules:
            return self.source.sparkSession.createDataFrame([], "rule_id string, matches bigint")
        parts = []
        for at in range(0, len(self.rules), RULES_PER_STAGE):
            own = range(at, min(at + RULES_PER_STAGE, len(self.rules)))
            sums = self.fired.agg(*[F.count_if(F.col(f"__r{i}")).alias(f"c{i}") for i in own])
            pairs = F.array(*[F.struct(F.lit(self.rules[i].id).alias("rule_id"), F.col(f"c{i}").alias("matches")) for i in own])
            parts.append(sums.select(F.inline(pairs)))
        return reduce(DataFrame.union, parts)

    def counts(self) -> DataFrame:
        """One row: n_records and n_matched."""
        return self.fired.agg(F.count("*").alias("n_records"), F.count_if(self.matched).alias("n_matched"))

    def decision_counts(self) -> DataFrame:
        """(decision, n, matched, total_score)."""
        return self.decisions().groupBy("decision").agg(F.count("*").alias("n"), F.count_if("matched").alias("matched"), F.sum("score").alias("total_score"))

    def observed(self, name: str = "rules") -> tuple[DataFrame, Observation]:
        """decisions() with counters that are filled while it runs: rows, matched rows, score range and sum, rows by decision."""
        counters = [F.count("*").alias("records"), F.count_if("matched").alias("matched"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.sum("score").alias("score_sum")]
        counters += [F.count_if(F.col("decision") == x).alias(f"decision_{x}") for x in self.registry.labels]
        seen = Observation(name)
        return self.decisions().observe(seen, *counters), seen

    def grouped(self, row_id: str) -> DataFrame:
        """(decision, rows): all row ids of each decision. The lists grow with the data; use filter_decision() for large inputs."""
        return self.decisions().groupBy("decision").agg(F.sort_array(F.collect_list(row_id)).alias("rows"))

    def filter_decision(self, *labels: str, negate: bool = False) -> DataFrame:
        hit = F.col("decision").isin([parser.decision_label(x) for x in labels])
        return self.decisions().where(~hit if negate else hit)

    def filter_rule(self, rule_id: str) -> DataFrame:
        i = next((i for i, r in enumerate(self.rules) if r.id == rule_id), None)
        if i is None:
            raise KeyError(rule_id)
        return self.fired.where(F.col(f"__r{i}")).select(*self._keep)

    def matched_only(self) -> DataFrame:
        """decisions() of the rows that some rule matches; where no column is derived, the conditions reach the scan as a filter."""
        late = any(isinstance(x, WindowLeaf | ModelLeaf | VectorLeaf) or (x.family == "lookup" and not self.engine.lookups[x.args[0]].inline) for x in self._leaves)
        if late:
            return self.decisions().where("matched")
        with for_filter(True):
            hit = reduce(or_, (compile_condition(r.condition, self._scope(r.id)) for r in self.rules), F.lit(False))
        return Evaluation(self.engine, self.source.where(hit), self.as_of_ms, self.clock).decisions()
