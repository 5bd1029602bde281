"""Answers questions about one table: structured, by steps, by search, or by a model."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from queue import Queue
from threading import Event

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from quaestor import render
from quaestor.errors import QUERY_MESSAGES, ModelError, QueryResult
from quaestor.memory import Memory
from quaestor.models import Embedder, HashingEmbedder, LanguageModel, OfflineModel, Told, grounding, semantic_confidence, structured_confidence
from quaestor.nl import grammar
from quaestor.operators import aggregates, filters, profile, search
from quaestor.operators.retrieval import Index
from quaestor.plans import plan as plans
from quaestor.plans import steps as step_plans
from quaestor.sources.readers import Dataset, load

CACHED, ACCEPT = 100, 0.8
TOLD = 300  # characters of an earlier answer that a model is told


@dataclass
class Answer:
    text: str
    engine: str = ""
    confidence: float = 0.0
    df: DataFrame | None = None
    plan: plans.QueryPlan | None = None
    count: int = 0
    intent: grammar.Intent | None = None
    suggestions: list[str] = field(default_factory=list)


def _sure(result: QueryResult) -> bool:
    """A structured answer that needs no other engine: a confident one, one that found something, or none for filters that the question states."""
    return result.success and bool(result.confidence > ACCEPT or result.data.count or result.data.plan.filters)


class Engine:
    """One table and a conversation about it.

    enhanced=False leaves out the structured and semantic engines, so that questions go to commands, search and model only.
    """

    def __init__(self, spark: SparkSession, model: LanguageModel | None = None, embedder: Embedder | None = None, memory: bool = True, enhanced: bool = True):
        self.spark, self.model, self.enhanced = spark, model or OfflineModel(), enhanced
        self.index, self.memory = Index(embedder or HashingEmbedder()), Memory() if memory else None
        self.ds: Dataset | None = None
        self._cache: OrderedDict[tuple, Answer] = OrderedDict()
        self._card: str | None = None
        self._on_change: list[Callable[[], None]] = [self._cache.clear, self.index.clear]

    # --- the table

    def on_change(self, call: Callable[[], None]) -> None:
        self._on_change.append(call)

    def load(self, path: str, kind: str | None = None) -> list[str]:
        """Loads a table and returns its columns; what was kept of another table, or of another state of it, goes."""
        return self.use(load(self.spark, path, kind))

    def use(self, ds: Dataset) -> list[str]:
        if self.ds is None or self.ds.fingerprint != ds.fingerprint or not ds.fingerprint:
            for call in self._on_change:
                call()
            self._card = None
        self.ds = ds
        return ds.columns

    def _tops(self, k: int = 5) -> DataFrame | None:
        return profile.top_values_of(self.ds.rows, self.ds.textual, k) if self.ds.textual else None

    def card(self) -> str:
        if self._card is None:
            self._card = render.card(profile.profile(self.ds, exact=False, median=False), self._tops(), self.ds.table)
        return self._card

    def suggest(self) -> list[str]:
        return render.suggestions(profile.profile(self.ds, exact=False, median=False), self._tops(), profile.date_columns(self.ds))

    def status(self) -> dict:
        return {"loaded": self.ds is not None, "enhanced": self.enhanced, "indexed": self.index._vectors is not None, "memory": self.memory is not None}

    def preview(self, n: int = 10) -> tuple[list[dict], int, int]:
        """(first n rows, rows, columns)."""
        return [r.asDict() for r in self.ds.table.limit(n).collect()], self.ds.table.count(), len(self.ds.columns)

    def info(self) -> DataFrame:
        """Type, values that are there and samples of each column."""
        return profile.column_info(self.ds).orderBy("position")

    # --- answering

    def ask(self, question: str, model: LanguageModel | None = None) -> Answer:
        """The answer; ``model`` stands in for the engine's model for this question."""
        question = (question or "").strip()
        if self.ds is None:
            return Answer("No table is loaded.")
        if not question:
            return Answer("Ask a question.")
        key = (question.lower(), self.ds.fingerprint)
        if self.memory is None and key in self._cache:
            self._cache.move_to_end(key)
            return self._cache[key]
        carried = self.memory.carried(question) if self.memory and self.memory.follow_up(question) else ()
        asked = self.memory.resolved(question) if carried else question
        try:
            answer = replace(self._answer(asked, carried, model or self.model), intent=grammar.intent(question, self.ds.columns))
        except ModelError as error:
            answer = Answer(str(error), "model")
        if self.memory is not None:
            filters = answer.plan.filters if answer.plan else carried
            self.memory.add(question, answer.text, filters or carried, answer.count, engine=answer.engine)
        elif not answer.suggestions:
            self._cache[key] = answer
            while len(self._cache) > CACHED:
                self._cache.popitem(last=False)
        return answer

    def stream(self, question: str) -> Iterator[str]:
        """The answer in pieces: a model's as they come, any other's word by word. What was added to a model's words follows them."""
        pieces: Queue = Queue()
        stopped = Event()

        def tell(piece: str) -> None:
            if stopped.is_set():
                raise ModelError("nobody reads the answer")
            pieces.put(piece)

        def run() -> None:
            try:
                pieces.put(self.ask(question, Told(self.model, tell)))
            except BaseException as error:  # goes on where the pieces are read
                pieces.put(error)

        try:
            worker = InheritableThread(run)
            worker.start()
            told = ""
            while isinstance(piece := pieces.get(), str):
                told += piece
                yield piece
            worker.join()
        finally:
            stopped.set()
        if isinstance(piece, BaseException):
            raise piece
        rest = piece.text if told.strip() not in piece.text else piece.text.replace(told.strip(), "", 1)
        yield from re.findall(r"\S+\s*|\s+", rest)

    def _told(self, question: str, *parts: str) -> str:
        """What a model is told: the table's card, more parts, and the earlier turns that bear on the question."""
        turns = self.memory.relevant(question) if self.memory else []
        earlier = ["Earlier in this conversation:\n" + "\n".join(f"Q: {t.question}\nA: {t.answer[:TOLD]}" for t in turns)] if turns else []
        return "\n\n".join([self.card(), *parts, *earlier])

    def _open(self, question: str) -> bool:
        """A question that the router sends to the semantic engine, and that states no filter, measure or group."""
        if grammar.route(question, self.ds.columns) != "semantic":
            return False
        plan = grammar.structured_plan(question, self.ds)
        return plan is None or not (plan.filters or plan.measures or plan.groupby or plan.operation == "summarize")

    def _answer(self, question: str, carried: tuple[plans.Filter, ...], model: LanguageModel) -> Answer:
        ds, columns = self.ds, self.ds.columns
        if grammar.is_help(question):
            found = self.suggest()
            return Answer("You can ask:\n" + "\n".join(f"- {s}" for s in found), "help", 1.0, suggestions=found)
        if grammar.is_complex(question, columns) and not carried:
            return self._steps(question, model)
        if self.enhanced and (carried or not self._open(question)):
            result = self.structured(question, carried)
            if _sure(result):
                return result.data
        if grammar.is_analysis(question, columns):
            return self._analysis(question, carried)
        keyword = grammar.keyword_of(question) or (question.strip("?.! ") if len(question.split()) <= 2 else None)
        corrected = grammar.corrected_command(question)
        asked = grammar.question_info(question, columns)
        if asked.id_column and asked.id_value and not carried and not corrected and grammar.mentions(question, columns):
            found = filters.lookup(ds, asked.id_column, asked.id_value).select(*[f"`{c}`" for c in columns])
            text, n = render.matches(found, asked.target_column, asked.id_column, asked.id_value)
            if n:
                plan = plans.QueryPlan("list", filters=(plans.Filter(asked.id_column, "contains", asked.id_value),), source=question)
                return Answer(text, "lookup", 0.9, found, plan, n)
        if keyword and not carried:
            found = search.ordered(search.search(ds, keyword)).select(*[f"`{c}`" for c in columns])
            text, n = render.table(found)
            if n:
                return Answer(f"Found {n} rows with '{keyword}':\n{text}", "search", 0.9, found, count=n)
        if corrected and len(question.split()) > 1:
            fixed = re.sub(r"^\s*[A-Za-z]+", corrected, question, count=1)
            return Answer(f"Did you mean: {fixed}?", "suggestion", 0.5, suggestions=[fixed])
        if keyword and len(keyword) < 10 and not search.any_row_contains(ds, keyword):
            near = [r.value for r in search.fuzzy(ds, keyword).collect()]
            if near:
                return Answer(f"'{keyword}' was not found. Did you mean: {', '.join(near)}?", "suggestion", 0.5, suggestions=near)
        planned = model.plan(question, self._told(question))
        if planned:
            return self._run(replace(plans.from_dict(planned), source=question), carried, "plan")
        return self.hybrid(question, model)

    def structured(self, question: str, carried: tuple[plans.Filter, ...] = ()) -> QueryResult:
        plan = grammar.structured_plan(question, self.ds)
        if plan is None:
            return QueryResult.fail("NO_MATCH", "structured")
        answer = self._run(plan, carried, "structured")
        score = answer.confidence = structured_confidence(question, answer.text, answer.count)
        return QueryResult.ok(answer, "structured", score)

    def _run(self, plan: plans.QueryPlan, carried: tuple[plans.Filter, ...], engine: str) -> Answer:
        plan = replace(plan, filters=carried + tuple(f for f in plan.filters if f not in carried))
        df = plans.compile_plan(plan, self.ds)
        if plan.operation == "aggregate" and not plan.groupby and len(plan.measures) == 1:
            m = plan.measures[0]
            found = self.ds.find(m.column)
            if found and self.ds.kinds[found] == "text" and m.function in ("max", "min", "mean", "sum"):
                rows = plans.compile_plan(replace(plan, operation="list", columns=(), measures=()), self.ds)
                df = aggregates.coerced(rows, m.function, found, found)
            value = df.head()[0]
            text = f"The {m.function} of {m.column} is {render.scalar(value)}." if value is not None else QUERY_MESSAGES["EMPTY_RESULT"]
            return Answer(text, engine, 0.9, df, plan, 0 if value is None else 1)
        if plan.operation == "count" and not plan.groupby:
            n = df.head()[0]
            return Answer(f"There are {n} records.", engine, 0.9, df, plan, n)
        text, n = render.table(df)
        return Answer(f"Found {n} rows:\n{text}" if n else QUERY_MESSAGES["EMPTY_RESULT"], engine, 0.9, df, plan, n)

    def _steps(self, question: str, model: LanguageModel) -> Answer:
        steps = step_plans.from_dict(model.steps(question, self._told(question))) or step_plans.default_steps(question, self.ds.columns)
        filters = tuple(plans.Filter(s.column, s.operator, s.value) for s in steps if s.type == "column_filter" and s.column)
        plan = plans.QueryPlan("list", filters=filters, source=question)
        found = step_plans.execute(self.ds, steps)
        if isinstance(found, dict):
            text, n = render.analysis(found)
            return Answer(text, "steps", 0.9, found["statistics"], plan, n)
        text, n = render.table(found)
        return Answer(f"Found {n} rows:\n{text}" if n else QUERY_MESSAGES["EMPTY_RESULT"], "steps", 0.9, found, plan, n)

    def _analysis(self, question: str, carried: tuple[plans.Filter, ...]) -> Answer:
        steps = [step_plans.Step("filter", "column_filter", column=f.column, operator=f.operator, value=f.value) for f in (*carried, *grammar.conditions(question, self.ds.columns))]
        targets = [c for _, _, c in grammar.mentions(question, self.ds.columns) if self.ds.kinds[c] == "numeric"]
        parts = profile.analyze(step_plans.narrowed(self.ds, steps), targets=targets or None)
        text, n = render.analysis(parts)
        return Answer(text, "analysis", 0.9, parts["statistics"], plans.QueryPlan("list", filters=carried), n)

    def semantic(self, question: str, model: LanguageModel | None = None) -> QueryResult:
        self.index.build(self.ds)
        found = self.index.search(question)
        rows = found.collect() if found is not None else []  # at most five
        if not rows:
            return QueryResult.fail("NO_CONTEXT", "semantic")
        context = self._told(question, *[r.text for r in reversed(rows)])
        text = (model or self.model).ask(question, context)
        score = semantic_confidence(text, self.ds.columns)
        return QueryResult.ok(Answer(text, "semantic", score, found, count=len(rows)), "semantic", score, grounding=grounding(text, context))

    def hybrid(self, question: str, model: LanguageModel | None = None) -> Answer:
        """Structured if it is sure and the question isn't an open one, else with what search finds, else the model on the table's card."""
        first = self.structured(question) if self.enhanced and not self._open(question) else QueryResult.fail("NO_MATCH")
        if _sure(first):
            return first.data
        second = self.semantic(question, model)
        if first.success and second.success:
            a, b = first.data.text, second.data.text
            text = f"{a}\n\n{b}" if len(a) > 50 and len(b) > 50 else max(a, b, key=len)
            return replace(first.data, text=text, engine="hybrid", confidence=0.85)
        if second.success:
            return second.data
        if first.success:
            return first.data
        text = (model or self.model).ask(question, self._told(question))
        return Answer(text or QUERY_MESSAGES["ALL_ENGINES_FAILED"], "model", 0.6)
