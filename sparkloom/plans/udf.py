"""User functions: row, batch, asynchronous, generator and class forms, with types from annotations."""

from __future__ import annotations

import asyncio
import functools
import inspect
import math
import typing
import warnings
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.operators.ai import data_type


def _plain(value: Any) -> Any:
    """What a function returned, as Spark takes it: Pydantic models and dataclasses become dicts."""
    if hasattr(value, "model_dump"):
        return value.model_dump()
    if hasattr(value, "__dataclass_fields__"):
        return {k: _plain(getattr(value, k)) for k in value.__dataclass_fields__}
    return [_plain(v) for v in value] if isinstance(value, list | tuple) else value


def _returns(f: Callable, given: Any) -> T.DataType | str:
    if given is not None:
        return given
    return data_type(typing.get_type_hints(f)["return"])


def _split(args: tuple, names: list[str], kwargs: dict) -> tuple[list[Column], Callable]:
    """Columns among the arguments, and what puts a row's values and the literals back in their places."""
    bound = [*zip(names, args, strict=False), *kwargs.items()]
    cols = [(n, a if isinstance(a, Column) else F.col(a)) for n, a in bound if isinstance(a, Column) or (isinstance(a, str) and a.startswith("`"))]
    fixed = {n: a for n, a in bound if not (isinstance(a, Column) or (isinstance(a, str) and a.startswith("`")))}
    order = [n for n, _ in cols]
    return [c for _, c in cols], lambda values: dict(zip(order, values, strict=True)) | fixed


def func(f: Callable | None = None, *, return_dtype: Any = None, on_error: str = "raise"):
    """A row function on columns: ``F.col`` arguments vary, all others are literals. ``async def`` runs a batch concurrently.

    on_error: "raise" or "null".
    """
    if f is None:
        return functools.partial(func, return_dtype=return_dtype, on_error=on_error)
    kind, names = _returns(f, return_dtype), list(inspect.signature(f).parameters)

    def build(*args: Any, **kwargs: Any) -> Column:
        cols, place = _split(args, names, kwargs)
        if inspect.iscoroutinefunction(f):

            @F.pandas_udf(kind)
            def run(*parts: pd.Series) -> pd.Series:
                async def one(row):
                    try:
                        return _plain(await f(**place(row)))
                    except Exception:
                        if on_error == "raise":
                            raise
                        return None

                async def every():
                    return await asyncio.gather(*[one(r) for r in zip(*parts, strict=True)])

                return pd.Series(asyncio.run(every()), dtype=object)

            return run(*cols)

        def row(*values):
            try:
                return _plain(f(**place(values)))
            except Exception:
                if on_error == "raise":
                    raise
                return None

        return F.udf(row, kind, useArrow=True)(*cols)

    return functools.wraps(f)(build)


def _tuple(parts: Any) -> tuple:
    """A batch's columns; a single column comes without its tuple."""
    return parts if isinstance(parts, tuple) else (parts,)


def batch(*, return_dtype: Any, batch_size: int | None = None):
    """A function of whole Series to a Series; literals are passed as they are. Its result must not depend on how rows are batched."""

    def wrap(f: Callable) -> Callable[..., Column]:
        names = list(inspect.signature(f).parameters)

        def build(*args: Any, **kwargs: Any) -> Column:
            cols, place = _split(args, names, kwargs)

            @F.pandas_udf(return_dtype)
            def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
                for parts in map(_tuple, batches):
                    n = len(parts[0])
                    step = batch_size or max(1, n)
                    done = [pd.Series(f(**place([p.iloc[i : i + step] for p in parts]))) for i in range(0, n, step)]
                    yield pd.concat(done, ignore_index=True) if done else pd.Series([], dtype=object)

            return run(*cols)

        return functools.wraps(f)(build)

    return wrap


_instances: dict[Any, Any] = {}


def _instance(cls: type, args: tuple, kwargs: tuple) -> Any:
    key = (cls.__qualname__, args, kwargs)
    if key not in _instances:
        _instances[key] = cls(*args, **dict(kwargs))
    return _instances[key]


def batch_method(*, return_dtype: Any, batch_size: int | None = None):
    """Marks a method as one of whole Series to a Series; :class:`Remote` calls it so."""

    def wrap(f: Callable) -> Callable:
        f._batch = (return_dtype, batch_size)
        return f

    return wrap


class Remote:
    """A class whose instances are made once in each worker process; its methods are functions on columns.

    Plain methods run row by row, ``async def`` methods on the rows of a batch together, at most ``max_concurrency`` at a time, and
    those marked :func:`batch_method` on whole Series. on_error: "raise", "null" or "log" (null, with a warning in the worker's log).
    """

    def __init__(self, cls: type, *args: Any, max_concurrency: int | None = None, **kwargs: Any):
        self._cls, self._args, self._kwargs, self._most = cls, args, tuple(sorted(kwargs.items())), max_concurrency

    def with_init_args(self, *args: Any, **kwargs: Any) -> Remote:
        return Remote(self._cls, *args, max_concurrency=self._most, **kwargs)

    def with_concurrency(self, most: int) -> Remote:
        return Remote(self._cls, *self._args, max_concurrency=most, **dict(self._kwargs))

    def __call__(self, *cols: Any, **kw: Any) -> Column:
        return self.method("__call__")(*cols, **kw)

    def method(self, name: str, return_dtype: Any = None, on_error: str = "raise") -> Callable[..., Column]:
        cls, args, kwargs, most = self._cls, self._args, self._kwargs, self._most
        f = getattr(cls, name)
        names = list(inspect.signature(f).parameters)[1:]
        given_kind, batch_size = getattr(f, "_batch", (return_dtype, None))
        # Settled here: a worker imports the class anew, without the marks that it was given in the driver.
        whole, waits = hasattr(f, "_batch"), inspect.iscoroutinefunction(f)
        kind = _returns(f, given_kind)

        def build(*given: Any, **kw: Any) -> Column:
            cols, place = _split(given, names, kw)

            def failed(error: Exception) -> None:
                if on_error == "raise":
                    raise error
                if on_error == "log":
                    warnings.warn(f"{cls.__name__}.{name}: {error!r}", stacklevel=2)

            def rows_of(batches: Iterator) -> Iterator[list]:
                one = getattr(_instance(cls, args, kwargs), name)

                def row(values):
                    try:
                        return _plain(one(**place(values)))
                    except Exception as e:
                        return failed(e)

                async def together(rows):
                    gate = asyncio.Semaphore(most or max(1, len(rows)))

                    async def each(values):
                        async with gate:
                            try:
                                return _plain(await one(**place(values)))
                            except Exception as e:
                                return failed(e)

                    return await asyncio.gather(*[each(r) for r in rows])

                # One loop for all batches of a task, so that clients which an instance keeps stay usable.
                with asyncio.Runner() as loop:
                    for parts in map(_tuple, batches):
                        rows = list(zip(*parts, strict=True))
                        if whole:
                            step = batch_size or max(1, len(rows))
                            done = [list(one(**place([p.iloc[i : i + step] for p in parts]))) for i in range(0, len(rows), step)]
                            yield [_plain(x) for some in done for x in some]
                        elif waits:
                            yield loop.run(together(rows))
                        else:
                            yield [row(r) for r in rows]

            def series(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
                for out in rows_of(batches):
                    yield pd.Series(out, dtype=object)

            def frames(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
                for out in rows_of(batches):
                    yield pd.DataFrame([r or {} for r in out], columns=kind.names)

            run = F.pandas_udf(frames if isinstance(kind, T.StructType) else series, kind)
            return run(*cols)

        return build


def resources(cpus: int | None = None, gpus: float | None = None, memory: str | None = None):
    """A profile of what a task needs; with gpus or memory also of what its executor has to have, which takes dynamic allocation.

    Local masters know no profiles but the default one, so a frame with one can be planned there but not run.
    """
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    task, executor, asks = TaskResourceRequests(), ExecutorResourceRequests(), False
    if cpus:
        task = task.cpus(cpus)
    if gpus:
        task, executor, asks = task.resource("gpu", gpus), executor.resource("gpu", max(1, math.ceil(gpus))), True
    if memory:
        executor, asks = executor.memory(memory), True
    profile = ResourceProfileBuilder().require(task)
    return (profile.require(executor) if asks else profile).build


def on_resources(df: DataFrame, remote: Remote, columns: list[str], name: str, return_dtype: str, method: str = "__call__", barrier: bool = False, **needs: Any) -> DataFrame:
    """``df`` with a column made by a method of a class function, row by row, in a stage of its own on executors with the cores, GPUs or memory it needs.

    ``needs`` are those of :func:`resources`, none for the default profile; ``barrier`` starts all tasks of the stage together. The instance is made once in each worker process.
    """
    cls, args, kwargs = remote._cls, remote._args, remote._kwargs
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(return_dtype))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = getattr(_instance(cls, args, kwargs), method)
        kind = to_arrow_type(schema[name].dataType)
        for batch in batches:
            out = [_plain(one(*row)) for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, name])

    return df.mapInArrow(run, schema, barrier, resources(**needs) if any(needs.values()) else None)


def legacy_udf(*, return_dtype: Any, batch_size: int | None = None):
    """The older form of user functions: a function of whole Series, or a class whose ``__call__`` is one; it may give a list.

    A class gives a maker: call it with its arguments (or none) for the column function.
    """

    def wrap(f: Any) -> Any:
        if inspect.isclass(f):
            f.__call__ = batch_method(return_dtype=return_dtype, batch_size=batch_size)(f.__call__)
            return functools.partial(Remote, f)
        return batch(return_dtype=return_dtype, batch_size=batch_size)(f)

    return wrap


def generator(*, return_dtype: str):
    """A generator function as a table function: each value yielded is a row, sibling columns repeat, and parents without rows go unless ``outer``."""

    def wrap(f: Callable) -> Callable:
        fields = [c.split(":")[0].split()[0] for c in return_dtype.split(",")]

        def rows(*values):
            return [r if isinstance(r, tuple | dict) else (r,) for r in f(*values)]

        def apply(df, *cols: str, outer: bool = False):
            made = F.udf(rows, f"array<struct<{return_dtype}>>")(*cols)
            each = (F.inline_outer if outer else F.inline)("_rows")
            keep = [c for c in df.columns if c not in fields]
            return df.withColumn("_rows", made).select(*keep, each)

        return functools.wraps(f)(apply)

    return wrap


def z_score(df, value: str, name: str = "z"):
    """Standard score over all rows with the population deviation; the whole table's, not a batch's."""
    stats = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(name, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def load_functions(spark, module) -> list[str]:
    """Register a module's public column functions that take plain Python values (marked ``sql_function``) under their names."""
    found = [n for n, f in vars(module).items() if callable(f) and getattr(f, "sql_function", None)]
    for n in found:
        f = getattr(module, n)
        spark.udf.register(n, f, f.sql_function)
    return found
