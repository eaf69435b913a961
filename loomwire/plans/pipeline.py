"""A pipeline of stages over named values.

Stages declare what they take and give; names can be mapped to the pipeline's. Since DataFrames
are lazy, running a stage only extends plans: actions happen where a stage asks for them. Stages
whose inputs are ready run together, each wave in threads, so that independent actions overlap.
"""

from __future__ import annotations

import importlib
import logging
import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from threading import Event, Timer
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomwire.schema import validate

log = logging.getLogger(__name__)

# Codes of the stages' errors.
ERROR_CODES = {"fetch": 1, "dedupe": 2, "truncate": 3, "read": 4, "summarize": 5, "history": 6, "format": 7, "merge_status": 8, "save": 9, "send": 10, "recency": 11}


class StageError(Exception):
    """A handled failure of a stage: its outputs do not come, and the error handler is told."""

    def __init__(self, code: int, cause: BaseException | str) -> None:
        super().__init__(f"error {code}: {cause}")
        self.code, self.cause = code, cause


@dataclass(frozen=True)
class Stage:
    """``apply(inputs, services, options) -> outputs``, or the path of such a function (module:name); inputs
    with a StructType are validated."""

    name: str
    apply: Callable[[Mapping[str, Any], Mapping[str, Any], Mapping[str, Any]], Mapping[str, Any]] | str
    inputs: Mapping[str, T.StructType | None] = field(default_factory=dict)
    outputs: tuple[str, ...] = ()
    code: int = 0
    names_in: Mapping[str, str] = field(default_factory=dict)
    names_out: Mapping[str, str] = field(default_factory=dict)

    def map_input(self, own: str, name: str) -> Stage:
        if own not in self.inputs:
            raise KeyError(f"{self.name} has no input {own}")
        return replace(self, names_in={**self.names_in, own: name})

    def map_output(self, own: str, name: str) -> Stage:
        if own not in self.outputs:
            raise KeyError(f"{self.name} has no output {own}")
        return replace(self, names_out={**self.names_out, own: name})

    def takes(self) -> dict[str, str]:
        return {own: self.names_in.get(own, own) for own in self.inputs}

    def gives(self) -> dict[str, str]:
        return {own: self.names_out.get(own, own) for own in self.outputs}


class Pipeline:
    def __init__(self, stages: Iterable[Stage], on_error: Callable[[StageError], None] | None = None, timeout: float | None = None, debug: bool = False) -> None:
        self.debug = debug
        self.stages = list(stages)
        names = [s.name for s in self.stages]
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise ValueError(f"stages of the same name: {sorted(twice)}")
        self.on_error, self.timeout = on_error, timeout

    def lint(self, given: Iterable[str] = (), wanted: Iterable[str] = ()) -> list[str]:
        """Names that are made and not used, or used and not made."""
        made = {n for s in self.stages for n in s.gives().values()} | set(given)
        used = {n for s in self.stages for n in s.takes().values()} | set(wanted)
        return [f"{n} is made but not used" for n in sorted(made - used)] + [f"{n} is used but not made" for n in sorted(used - made)]

    def set_timeout(self, seconds: float | None) -> Pipeline:
        self.timeout = seconds
        return self

    def set_debug(self, debug: bool) -> Pipeline:
        """With debug a run logs what lint finds, and the name and seconds of each stage."""
        self.debug = debug
        return self

    def run(self, inputs: Mapping[str, Any], outputs: Iterable[str], services: Mapping[str, Any] | None = None, options: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """Values of ``outputs``. A StageError is handed to the error handler, what depends on the stage
        does not run, and missing outputs are None. Invalid inputs and all other failures end the run.
        Where two stages make the same name, the first of a wave counts."""
        outputs = list(outputs)
        made = {n for s in self.stages for n in s.gives().values()}
        unknown = [n for n in inputs if n not in {x for s in self.stages for x in s.takes().values()}] + [n for n in outputs if n not in made and n not in inputs]
        if unknown:
            raise KeyError(f"unknown names: {unknown}")
        if self.debug:
            for note in self.lint(inputs, outputs):
                log.warning("%s", note)
        values: dict[str, Any] = dict(inputs)
        waiting = list(self.stages)
        spark = SparkSession.getActiveSession()
        tag = f"pipeline-{id(self)}"
        late = Event()

        def stop() -> None:
            late.set()
            if spark:
                spark.interruptTag(tag)

        timer = Timer(self.timeout, stop) if self.timeout else None
        if timer:
            timer.daemon = True
            timer.start()
        try:
            while not all(n in values for n in outputs):
                if late.is_set():
                    raise TimeoutError(f"the pipeline took more than {self.timeout} seconds")
                ready = [s for s in waiting if all(n in values for n in s.takes().values())]
                if not ready:
                    break
                waiting = [s for s in waiting if s not in ready]
                with ThreadPoolExecutor(max_workers=len(ready)) as pool:
                    done = list(pool.map(lambda s: self._one(s, values, services or {}, options or {}, spark, tag if timer else None), ready))
                for found in done:
                    for name, value in found.items():
                        values.setdefault(name, value)
            if late.is_set():
                raise TimeoutError(f"the pipeline took more than {self.timeout} seconds")
        finally:
            if timer:
                timer.cancel()
        return {n: values.get(n) for n in outputs}

    def _one(self, stage: Stage, values: Mapping[str, Any], services: Mapping[str, Any], options: Mapping[str, Any], spark: SparkSession | None, tag: str | None) -> dict[str, Any]:
        if tag and spark:
            spark.addTag(tag)
        given = {own: values[name] for own, name in stage.takes().items()}
        for own, schema in stage.inputs.items():
            if schema is not None and isinstance(given[own], DataFrame):
                given[own] = validate(given[own], schema, f"{stage.name}.{own}")
        start = time.monotonic()
        try:
            apply = stage.apply
            if isinstance(apply, str):  # a stage by the path of its function
                module, _, name = apply.partition(":")
                apply = getattr(importlib.import_module(module), name or "apply")
            found = apply(given, services, options)
            if self.debug:
                log.info("stage %s took %.3f s", stage.name, time.monotonic() - start)
        except StageError as e:
            log.error("stage %s: %s", stage.name, e)
            if self.on_error:
                self.on_error(e)
            return {}
        except Exception as e:
            log.error("stage %s: %s", stage.name, e)
            if not stage.code:
                raise
            if self.on_error:
                self.on_error(StageError(stage.code, e))
            return {}
        extra = set(found) - set(stage.outputs)
        if extra:
            raise KeyError(f"{stage.name} gave {sorted(extra)}, which it did not declare")
        return {stage.gives()[own]: value for own, value in found.items()}
