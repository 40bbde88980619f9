"""Interfaces for readers and models that need software or a network that this installation lacks.

A reader turns one file into lines, a model turns one prompt into JSON. ``lines_of`` and ``answers_of`` run them per
partition and turn failures into rows, so a plug-in needs no Spark of its own. ``Replay`` is the reader of recorded
results used offline and in tests.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class LineReader(Protocol):
    """File content to (page, line_no, text, confidence)."""

    def lines(self, path: str, content: bytes) -> Iterator[tuple[int, int, str, float]]: ...


class Model(Protocol):
    """A prompt to a JSON text."""

    def answer(self, prompt: str) -> str: ...


class Replay:
    """Reads a recorded list of {page, text, confidence} objects."""

    def lines(self, path: str, content: bytes) -> Iterator[tuple[int, int, str, float]]:
        for n, x in enumerate(json.loads(content), 1):
            if str(x.get("text") or "").strip():
                yield int(x.get("page", 1)), n, str(x["text"]).strip(), float(x.get("confidence") or 0.0)


class Unavailable:
    """Stands for a reader whose library is not installed."""

    def __init__(self, what: str):
        self.what = what

    def lines(self, path: str, content: bytes) -> Iterator[tuple[int, int, str, float]]:
        raise RuntimeError(f"{self.what} is not installed")
        yield  # pragma: no cover


def pdf_reader() -> LineReader:
    """A text reader for PDF files if its library can be imported."""
    try:
        import pypdf
    except ImportError:
        return Unavailable("pypdf")

    class Pages:
        def lines(self, path: str, content: bytes) -> Iterator[tuple[int, int, str, float]]:
            import io

            for p, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1):
                for n, line in enumerate((page.extract_text() or "").splitlines(), 1):
                    if line.strip():
                        yield p, n, line.strip(), 1.0

    return Pages()


def lines_of(files: DataFrame, make: Callable[[], LineReader]) -> DataFrame:
    """(path, page, line_no, text, confidence, error) of files (path, content); a failure is a row with its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    out += [(path, *x, None) for x in reader.lines(path, content)]
                except Exception as x:  # noqa: BLE001 - whatever a plug-in raises becomes a row
                    out.append((path, None, None, None, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=["path", "page", "line_no", "text", "confidence", "error"]).astype({"page": "Int32", "line_no": "Int32", "confidence": "float64"})

    return files.select("path", "content").mapInPandas(read, "path string, page int, line_no int, text string, confidence double, error string")


def answers_of(prompts: DataFrame, key: str, prompt: str, make: Callable[[], Model], tries: int = 2) -> DataFrame:
    """(key, answer, error): the model's answer to each prompt, tried ``tries`` times."""
    kind = prompts.schema[key].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            out = []
            for k, p in zip(b[key], b[prompt]):
                answer = error = None
                for _ in range(tries):
                    try:
                        answer, error = model.answer(p), None
                        break
                    except Exception as x:  # noqa: BLE001
                        error = f"{type(x).__name__}: {x}"
                out.append((k, answer, error))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return prompts.select(key, prompt).mapInPandas(ask, f"{key} {kind}, answer string, error string")
