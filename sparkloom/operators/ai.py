"""Model calls as column operators behind a provider, with a deterministic offline stand-in.

``OfflineProvider`` is a stand-in: it answers from rules and hashes, needs no network, and says nothing about the quality of any
model. Real providers implement the same four methods; they are sent to executors, so they must pickle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Provider(Protocol):
    def prompt(self, messages: Sequence[str], system: str | None, **options: Any) -> str: ...

    def embed_text(self, text: str, dimensions: int) -> Sequence[float]: ...

    def embed_image(self, data: bytes, dimensions: int) -> Sequence[float]: ...

    def classify(self, text: str, labels: Sequence[str]) -> Sequence[float]: ...


class OfflineProvider:
    """Deterministic answers without any model."""

    def prompt(self, messages: Sequence[str], system: str | None = None, **options: Any) -> str:
        text = "\n".join(messages)
        if schema := options.get("fields"):
            return json.dumps({name: self._field(name, kind, text) for name, kind in schema.items()})
        if options.get("choices"):
            return options["choices"][self._number(text) % len(options["choices"])]
        return f"{(system or 'answer')[:20]}: {' '.join(text.split()[:12])}"

    @staticmethod
    def _number(text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")

    def _field(self, name: str, kind: str, text: str) -> Any:
        n = self._number(name + "\0" + text)
        return {"bool": bool(n % 2), "int": n % 100, "float": n % 1000 / 1000, "list": sorted(set(text.lower().split()))[:3]}.get(kind, " ".join(text.split()[:5]))

    def embed_text(self, text: str, dimensions: int = 64) -> Sequence[float]:
        """Signed feature hashing of the words, at unit length."""
        out = np.zeros(dimensions)
        for w in re.findall(r"\w+", text.lower()):
            n = self._number(w)
            out[n // 2 % dimensions] += 1 if n % 2 else -1
        size = np.linalg.norm(out)
        return (out / size if size else out).tolist()

    def embed_image(self, data: bytes, dimensions: int = 64) -> Sequence[float]:
        out = np.bincount(np.frombuffer(data, dtype=np.uint8) % dimensions, minlength=dimensions).astype(float)
        size = np.linalg.norm(out)
        return (out / size if size else out).tolist()

    def classify(self, text: str, labels: Sequence[str]) -> Sequence[float]:
        a = np.array(self.embed_text(text))
        return [float(a @ np.array(self.embed_text(label))) for label in labels]


class ProviderRegistry:
    """Named providers, one of them current."""

    def __init__(self):
        self._known: dict[str, Provider] = {"offline": OfflineProvider()}
        self._current = "offline"

    def attach(self, name: str, provider: Provider) -> None:
        self._known[name] = provider

    def detach(self, name: str) -> None:
        del self._known[name]
        if self._current == name:
            self._current = "offline"

    def has(self, name: str) -> bool:
        return name in self._known

    def get(self, name: str | None = None) -> Provider:
        return self._known[name or self._current]

    def set(self, name: str, provider: Provider | None = None) -> None:
        if provider is not None:
            self.attach(name, provider)
        self.get(name)
        self._current = name

    def current(self) -> str:
        return self._current

    @contextmanager
    def using(self, name: str) -> Iterator[Provider]:
        before, _ = self._current, self.set(name)
        try:
            yield self.get(name)
        finally:
            self._current = before


PROVIDERS = ProviderRegistry()


def _provider(p: str | Provider | None) -> Provider:
    return PROVIDERS.get(p) if p is None or isinstance(p, str) else p


def _guard(on_error: str):
    def call(f, *args):
        try:
            return f(*args)
        except Exception:
            if on_error == "raise":
                raise
            return None

    return call


def _batched(f, rows: list, concurrency: int) -> list:
    if concurrency <= 1:
        return [f(r) for r in rows]
    with ThreadPoolExecutor(concurrency) as pool:
        return list(pool.map(f, rows))


def prompt(
    messages: str | Column | Sequence[str | Column],
    system_message: str | None = None,
    provider: str | Provider | None = None,
    return_format: type | None = None,
    concurrency: int = 8,
    on_error: str = "raise",
    **options: Any,
) -> Column:
    """A model's answer to one or several message columns; with ``return_format`` (TypedDict or Pydantic model) a struct of its fields.

    A null message gives null. Calls of one batch run concurrently. on_error: "raise" or "null".
    """
    p, cols = _provider(provider), [messages] if isinstance(messages, str | Column) else list(messages)
    guard = _guard(on_error)
    if return_format is not None:
        options["fields"] = _field_kinds(return_format)

    @F.pandas_udf("string")
    def run(*parts: pd.Series) -> pd.Series:
        def one(row):
            return None if any(x is None or x is pd.NA or (isinstance(x, float) and x != x) for x in row) else guard(lambda: p.prompt([str(x) for x in row], system_message, **options))

        return pd.Series(_batched(one, list(zip(*parts, strict=True)), concurrency), dtype=object)

    # A paid call must not run twice because its column is used twice.
    text = run.asNondeterministic()(*cols)
    return text if return_format is None else F.from_json(text, struct_type(return_format))


def embed_text(c: str | Column, provider: str | Provider | None = None, dimensions: int = 64) -> Column:
    p = _provider(provider)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [float(x) for x in p.embed_text(t, dimensions)], na_action="ignore").astype(object)

    return run(c)


def embed_image(c: str | Column, provider: str | Provider | None = None, dimensions: int = 64) -> Column:
    p = _provider(provider)

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: [float(x) for x in p.embed_image(bytes(b), dimensions)], na_action="ignore").astype(object)

    return run(c)


def classify_text(c: str | Column, labels: Sequence[str], provider: str | Provider | None = None, multi_label: bool = False, threshold: float = 0.0) -> Column:
    """The best label, the first on ties; with ``multi_label`` all whose score is above ``threshold``, in the labels' order."""
    p, labels = _provider(provider), list(labels)

    @F.pandas_udf("array<string>" if multi_label else "string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            scores = p.classify(t, labels)
            return [x for x, y in zip(labels, scores, strict=True) if y > threshold] if multi_label else labels[int(np.argmax(scores))]

        return s.map(one, na_action="ignore").astype(object)

    return run(c)


def classify_image(c: str | Column, labels: Sequence[str], provider: str | Provider | None = None) -> Column:
    """The label whose embedding is nearest to the image's, the first on ties; null for null."""
    p, labels = _provider(provider), list(labels)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = np.array([p.embed_text(x, 64) for x in labels])
        for s in batches:
            yield s.map(lambda b: labels[int(np.argmax(known @ np.array(p.embed_image(bytes(b), 64))))], na_action="ignore").astype(object)

    return run(c)


def llm_generate(input_column: str | Column, model: str | None = None, provider: str | Provider | None = None, concurrency: int = 8, extra_body: dict | None = None, **options: Any) -> Column:
    """A model's text for each input, the older form of :func:`prompt`; ``guided_choice`` in ``extra_body`` limits the answers to a list."""
    body = dict(extra_body or {})
    choices = body.pop("guided_choice", None)
    return prompt(input_column, provider=provider, concurrency=concurrency, **({"choices": choices} if choices else {}), **({"model": model} if model else {}), **body, **options)


#: Spark types of Python annotations.
_TYPES = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def data_type(hint: Any) -> T.DataType:
    """The Spark type of an annotation: scalars, list[...], dict[...], optional types, TypedDict, dataclasses, Pydantic models."""
    import types
    import typing

    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if hint in _TYPES:
        return _TYPES[hint]
    if origin is list:
        return T.ArrayType(data_type(args[0]))
    if origin is dict:
        return T.MapType(data_type(args[0]), data_type(args[1]))
    if origin in (typing.Union, types.UnionType):
        return data_type(next(a for a in args if a is not type(None)))
    if origin is typing.Literal:
        return data_type(type(args[0]))
    return struct_type(hint)


def struct_type(model: type) -> T.StructType:
    """The struct of a TypedDict, dataclass or Pydantic model."""
    import typing

    return T.StructType([T.StructField(n, data_type(h)) for n, h in typing.get_type_hints(model).items() if not n.startswith(("_", "model_config"))])


def _field_kinds(model: type) -> dict[str, str]:
    kinds = {T.StringType: "str", T.LongType: "int", T.DoubleType: "float", T.BooleanType: "bool", T.ArrayType: "list"}
    return {f.name: kinds.get(type(f.dataType), "str") for f in struct_type(model)}
