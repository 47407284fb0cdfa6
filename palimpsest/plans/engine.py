"""One method a term of the algebra, each a lazy DataFrame; execute() answers a term with its outcome and coverage."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import TERMS as CHAT
from palimpsest.functions.text import masked, matched, tokens
from palimpsest.operators import graph, knowledge, reads, resolution, telemetry, temporal
from palimpsest.operators.components import components
from palimpsest.plans import algebra
from palimpsest.sources import log as event_log
from palimpsest.sources import model as m

#: Rows that exemplars gives, days that the log keeps, and the most turns of a chat timeline.
EXEMPLARS, RETENTION, TURNS = 5, timedelta(days=90), 500


@dataclass
class Answer:
    """outcome, rows (None unless OK or PARTIAL or NO_DATA), the term's key, the part of its window that was covered, and why not."""

    outcome: str
    rows: DataFrame | None
    key: str
    coverage: tuple | None = None
    reason: str = ""


def instant(value: str | datetime) -> datetime:
    """An instant in UTC, from text with or without T, zone or fraction."""
    at = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


class Engine:
    """Queries over a folder of tables. known: the observed instant that graph reads see."""

    def __init__(self, spark: SparkSession, folder: str, known: str = m.KNOWN):
        self.spark, self.folder, self.known = spark, folder, m.at(known)
        self.asked: dict[str, algebra.Term] = {}

    def _edges(self, valid_at: str) -> DataFrame:
        return temporal.as_of(m.edges(self.spark, self.folder), m.at(valid_at), self.known)

    def _nodes(self, valid_at: str) -> DataFrame:
        return temporal.as_of(m.versions(self.spark, self.folder), m.at(valid_at), self.known)

    def _focus(self, focus: str) -> DataFrame:
        return self.spark.createDataFrame([(focus, focus)], "focus string, node string")

    def subgraph(self, focus: str, valid_at: str, hops: int = graph.HOPS, direction: str = "both", edge_types: list[str] | None = None, min_weight: int | None = None) -> DataFrame:
        return graph.subgraph(graph.selected(self._edges(valid_at), edge_types, min_weight), self._focus(focus), hops, direction)[1]

    def impact(self, focus: str, valid_at: str, hops: int = 3) -> DataFrame:
        return graph.impact(self._edges(valid_at), self._nodes(valid_at), self._focus(focus), hops)

    def changes(self, focus: str, start: str, end: str, hops: int = 2, margin: int = 0, reference_at: str | None = None) -> DataFrame:
        """The ranked changes of a diff."""
        near = graph.diff_reach(self._edges(start), self._edges(end), self._focus(focus), hops, margin) if margin else graph.reach(self._edges(end), self._focus(focus), hops)
        found = graph.candidates(m.changes(self.spark, self.folder), near, m.at(start), m.at(end))
        return graph.rank(found, m.at(reference_at or end), hops + margin)

    def diff(self, focus: str, start: str, end: str, hops: int = 2, margin: int = 1, reference_at: str | None = None) -> dict[str, DataFrame]:
        """What changed around a focus: nodes, edges, ranked changes and their targets."""
        before, after = self._edges(start), self._edges(end)
        hood = graph.neighbourhood(before, after, self._focus(focus), hops)
        ranked = self.changes(focus, start, end, hops, margin, reference_at)
        content = ["state", "value"]
        return {
            "nodes": graph.diff_focus_nodes(hood, self._nodes(start), self._nodes(end), content),
            "edges": graph.diff_focus_edges(hood, before, after),
            "changes": ranked,
            "targets": graph.change_targets(ranked.withColumn("focus", F.lit(focus)), self._nodes(start), self._nodes(end), content),
        }

    def truncation(self, focus: str, valid_at: str, hops: int = graph.HOPS, direction: str = "both") -> DataFrame:
        """Why a subgraph is cut; no row if it isn't."""
        return graph.truncation(self._edges(valid_at), self._focus(focus), hops, direction)

    def shortest_route(self, focus: str, valid_at: str, hops: int = 3) -> DataFrame:
        return graph.shortest_route(self._edges(valid_at), self._focus(focus), hops)

    def suggestions(self, focus: str | None = None, after: tuple[float, str] | None = None, size: int = 20) -> DataFrame:
        """A page of the pairs that rules find, by score and pair."""
        found = resolution.suggestions(m.claims(self.spark, self.folder)).withColumn("pair", F.concat_ws("|", "a", "b"))
        return reads.review_page(found, "pair", ["a", "b"], None, focus, after, size)

    def invariants(self) -> DataFrame:
        """Edges that begin before an earlier one of the same ends and type is over; none in a sound graph of one source."""
        rows = m.edges(self.spark, self.folder).withColumn("key", F.concat_ws("|", "src", "dst", "type", F.col("observed_from").cast("string")))
        return temporal.overlapping(rows, "key", ["valid_from", "edge_id"])

    def pointers(self, focus: str, valid_at: str) -> DataFrame:
        """kind, selector of where an entity's telemetry is, at an instant."""
        kind = F.when(F.col("k") % 3 == 0, "logs").when(F.col("k") % 3 == 1, "metrics").otherwise("traces")
        selector = F.concat(F.lit("svc="), "entity", F.lit(",type="), "state")
        return self._nodes(valid_at).where(F.col("entity") == focus).select(kind.alias("kind"), selector.alias("selector")).distinct().orderBy("kind", "selector")

    def node_history(self, focus: str) -> DataFrame:
        return m.versions(self.spark, self.folder).where(F.col("entity") == focus).orderBy("observed_from", "valid_from", "event_id")

    def resolution_audit(self, focus: str) -> DataFrame:
        """a, b, rule, score, canonical of every pair that rules find in the focus's component of certain pairs, or with it."""
        claims = m.claims(self.spark, self.folder)
        found = resolution.suggestions(claims)
        joined = components(found.where("rule like 'C%'"))
        own = joined.where(F.col("entity") == focus).select("component")
        members = joined.join(own, "component", "left_semi").select("entity").unionByName(self.spark.createDataFrame([(focus,)], "entity string")).distinct()
        touching = found.join(members.withColumnRenamed("entity", "a"), "a", "left_semi").unionByName(found.join(members.withColumnRenamed("entity", "b"), "b", "left_semi")).distinct()
        return touching.join(joined.select(F.col("entity").alias("a"), F.col("component").alias("canonical")), "a", "left").select("a", "b", "rule", "score", F.coalesce("canonical", "a").alias("canonical"))

    def extent(self) -> DataFrame:
        return event_log.extent(m.assertions(self.spark, self.folder))

    def _points(self, focus: str) -> DataFrame:
        return m.assertions(self.spark, self.folder).where(F.col("entity") == focus)

    def _within(self, window: tuple[str, str]) -> Column:
        return (F.col("valid_from") >= m.at(str(window[0]))) & (F.col("valid_from") < m.at(str(window[1])))

    def compare(self, focus: str, baseline: tuple[str, str], symptom: tuple[str, str]) -> DataFrame:
        return telemetry.compare(self._points(focus), "entity", self._within(baseline), self._within(symptom), "value")

    def onset(self, focus: str, window: tuple[str, str]) -> DataFrame:
        rows = self._points(focus).where(self._within(window)).withColumn("at", F.unix_seconds("valid_from"))
        return telemetry.onset(rows, "entity", "at", "value")

    def errors_by_version(self, focus: str, window: tuple[str, str]) -> DataFrame:
        return telemetry.errors_by(self._points(focus).where(self._within(window)), "source", F.col("state") == "error", "valid_from").orderBy(F.desc("rate"), "source")

    def error_spans(self, focus: str, window: tuple[str, str]) -> DataFrame:
        rows = self._points(focus).where(self._within(window) & (F.col("state") == "error"))
        return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), telemetry.nearest_rank(F.collect_list("value"), 0.95).alias("p95"))

    def monitor_state(self, focus: str, window: tuple[str, str]) -> DataFrame:
        return telemetry.transitions(self._points(focus).where(self._within(window)), "entity", ["valid_from", "event_id"])

    def _lines(self, focus: str, window: tuple[str, str]) -> DataFrame:
        line = F.concat_ws(" ", F.col("valid_from").cast("string"), "state", "source", F.format_string("value=%.2f took %dms", F.col("value"), F.col("k")))
        return self._points(focus).where(self._within(window)).select(masked(line).alias("template"), "valid_from")

    def new_log_patterns(self, focus: str, baseline: tuple[str, str], symptom: tuple[str, str]) -> DataFrame:
        """template, n, first_seen of the focus's masked lines that the baseline doesn't have."""
        new = self._lines(focus, symptom).groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("valid_from").alias("first_seen"))
        return new.join(self._lines(focus, baseline).select("template"), "template", "left_anti").orderBy(F.desc("n"), "template")

    def _behind(self, handle: str) -> DataFrame:
        """The points behind a row of an answer: handle is the term's key, a colon and the row's name."""
        key, _, row = handle.partition(":")
        if key not in self.asked:
            raise algebra.InvalidTerm("the handle is of no answer given before")
        own = dict(self.asked[key].fields)
        rows = self._points(own["focus"]).where(self._within(own.get("window") or own["symptom"]))
        name = {"errors_by_version": "source", "error_spans": "source", "monitor_state": "state"}.get(self.asked[key].name)
        return rows.where(F.col(name) == row) if name and row else rows

    def exemplars(self, handle: str) -> DataFrame:
        """A few points behind a row of an answer, the first by time."""
        return self._behind(handle).orderBy("valid_from", "event_id").limit(EXEMPLARS)

    def drill_down(self, handle: str) -> DataFrame:
        return self._behind(handle).orderBy("valid_from", "event_id")

    def knowledge_search(self, text: str, k: int = 10) -> DataFrame:
        """The k best documents for a text, by BM25 of its terms."""
        terms = self.spark.range(1).select(tokens(F.lit(text)).alias("t")).first()["t"]
        docs = m.table(self.spark, self.folder, "documents")
        if not terms:
            return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        return knowledge.bm25(docs, terms, "doc_id", "text").orderBy(F.desc("score"), "doc_id").limit(k)

    def _chat(self, window: tuple[int, int]) -> DataFrame:
        return m.table(self.spark, self.folder, "conversations").where((F.col("turn") >= int(window[0])) & (F.col("turn") < int(window[1])))

    def chat_mentions(self, window: tuple[int, int]) -> DataFrame:
        """Classes of words in the turns of a window."""
        rows = self._chat(window).select("turn", "role", F.explode(matched(F.col("text"), CHAT)).alias("class"))
        return rows.groupBy("class").agg(F.count(F.lit(1)).alias("mentions"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.countDistinct("role").alias("authors"))

    def chat_timeline(self, window: tuple[int, int], bucket: int = 1) -> DataFrame:
        """bucket, messages, authors for every bucket of turns in a window, empty ones too; at most TURNS buckets."""
        first, last = int(window[0]) // bucket, (int(window[1]) - 1) // bucket
        if last - first >= TURNS:
            raise algebra.InvalidTerm(f"a timeline has at most {TURNS} buckets")
        rows = self._chat(window).withColumn("bucket", F.floor(F.col("turn") / bucket))
        spine = self.spark.range(first, last + 1).select(F.col("id").alias("bucket"))
        return spine.join(rows, "bucket", "left").groupBy("bucket").agg(F.count("conv_id").alias("messages"), F.countDistinct("role").alias("authors"))

    def _covered(self, window: tuple) -> tuple[str, tuple | None, str]:
        """Outcome, covered part and reason of a window against what the log has and keeps."""
        seen = m.assertions(self.spark, self.folder).agg(F.min("valid_from").alias("a"), F.max("valid_from").alias("b")).first()
        start, end = instant(window[0]), instant(window[1])
        if seen["b"] is None or start > seen["b"]:
            return "NOT_YET_INGESTED", None, f"the log ends at {seen['b']}"
        kept = max(seen["a"], seen["b"] - RETENTION)
        if end <= kept:
            return "OUTSIDE_RETENTION", None, f"the log begins at {kept}"
        covered = (max(start, kept), min(end, seen["b"] + timedelta(microseconds=1)))
        whole = covered == (start, end)
        return "OK" if whole else "PARTIAL", covered, "" if whole else f"the log has {kept} to {seen['b']}"

    def execute(self, term: algebra.Term) -> Answer:
        """Normalise, validate, run. A window that the log hasn't got to, or has dropped, says so; one that it has in part is
        PARTIAL; an empty answer is NO_DATA; an error of the run is QUERY_FAILED. An invalid term raises InvalidTerm."""
        term = algebra.normalise(term)
        algebra.validate(term)
        own, key = dict(term.fields), algebra.key(term)
        self.asked[key] = term
        window, outcome, covered, reason = None, "OK", None, ""
        if algebra.TERMS[term.name][0] == "telemetry":
            window = own.get("window") or own.get("symptom")
        if window is not None:
            outcome, covered, reason = self._covered(window)
            if outcome not in ("OK", "PARTIAL"):
                return Answer(outcome, None, key, covered, reason)
        names = {"from": "start", "to": "end"}
        try:
            made = getattr(self, "changes" if term.name == "diff" else term.name)(**{names.get(k, k): v for k, v in own.items()})
            empty = made.isEmpty()
        except (PySparkException, Py4JError, TypeError) as error:
            return Answer("QUERY_FAILED", None, key, covered, str(error))
        return Answer("NO_DATA" if empty and outcome == "OK" else outcome, made, key, covered, reason)
