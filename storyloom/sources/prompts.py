"""Prompt templates with declared variables, rendered in the driver or as a column."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import text_of

_VARIABLE = re.compile(r"{([A-Za-z_][A-Za-z0-9_]*)}")


@dataclass(frozen=True)
class Prompt:
    """A template, the names it declares, and those of them that must be given."""

    template: str
    declared: tuple[str, ...] = ()
    required: tuple[str, ...] = ()

    @staticmethod
    def of(payload: Mapping) -> Prompt:
        """From a parsed file: template, task_variables and static_variables, lists of (name, required)."""
        template = payload.get("template")
        if not isinstance(template, str) or not template.strip():
            raise ValueError("a prompt has no template")
        variables = [v for kind in ("task_variables", "static_variables") for v in payload.get(kind) or [] if isinstance(v, Mapping) and str(v.get("name") or "").strip()]
        return Prompt(template, tuple(v["name"].strip() for v in variables), tuple(v["name"].strip() for v in variables if v.get("required") is True))

    def _check(self, given: Sequence[str]) -> None:
        missing = sorted(n for n in self.required if n not in given)
        if missing:
            raise ValueError(f"variables are missing: {missing}")

    def parts(self) -> list[tuple[bool, str]]:
        """The template in pieces: (whether a declared variable, text or name). Braces around other names are text."""
        out, at = [], 0
        for m in _VARIABLE.finditer(self.template):
            if m[1] in self.declared:
                out += [(False, self.template[at : m.start()]), (True, m[1])]
                at = m.end()
        return [p for p in [*out, (False, self.template[at:])] if p[1]]

    def render(self, strict: bool = True, **values) -> str:
        """The text with its variables; missing optional ones are empty, values other than text are JSON."""
        if strict:
            self._check(list(values))
        said = {n: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False, indent=2) if isinstance(v, (dict, list)) else str(v) for n, v in values.items()}
        return "".join(said.get(p, "") if variable else p for variable, p in self.parts())

    def column(self, **values: Column | str) -> Column:
        """The prompt of every row: values are columns (or names of columns), null ones empty."""
        self._check(list(values))
        return F.concat(F.lit(""), *(text_of(values[p]) if variable and p in values else F.lit("" if variable else p) for variable, p in self.parts()))
