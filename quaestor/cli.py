"""Command line: python -m quaestor.cli -f table.csv "question", or -i to talk."""

from __future__ import annotations

import argparse
import sys

from quaestor.engine import Engine
from quaestor.errors import QuaestorError
from quaestor.models import HttpEmbedder, HttpModel
from quaestor.session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quaestor", description="Ask questions about a table.")
    p.add_argument("question", nargs="*")
    p.add_argument("-f", "--file", required=True)
    p.add_argument("-m", "--model", help="name of a model behind HTTP; offline answers by default")
    p.add_argument("--embedding-model")
    p.add_argument("-i", "--interactive", action="store_true")
    p.add_argument("-d", "--debug", action="store_true", help="show the engine, the plan and the physical plan")
    p.add_argument("--no-context", action="store_true", help="forget each question at once")
    p.add_argument("--save-history")
    p.add_argument("--load-history")
    a = p.parse_args(argv)
    spark = session()
    engine = Engine(spark, HttpModel(a.model) if a.model else None, HttpEmbedder(a.embedding_model) if a.embedding_model else None, memory=not a.no_context)
    try:
        print("Columns: " + ", ".join(engine.load(a.file)))
    except QuaestorError as error:
        print(error, file=sys.stderr)
        return 1
    if a.load_history and engine.memory is not None:
        engine.memory.load(a.load_history)

    def say(question: str) -> None:
        answer = engine.ask(question)
        print(answer.text)
        if a.debug:
            print(f"[{answer.engine}, {answer.confidence:.2f}] {answer.plan}")
            if answer.df is not None:
                answer.df.explain("formatted")

    if a.question:
        say(" ".join(a.question))
    if a.interactive or not a.question:
        for line in sys.stdin:
            line = line.strip()
            if line in ("/q", "/quit", "exit"):
                break
            if line == "/summary":
                print(engine.memory.summary() if engine.memory else "no memory")
            elif line == "/clear":
                engine.memory.clear() if engine.memory else None
            elif line:
                say(line)
    if a.save_history and engine.memory is not None:
        engine.memory.save(a.save_history)
    return 0


if __name__ == "__main__":
    sys.exit(main())
