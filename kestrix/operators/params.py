"""Parameters with types, checks and defaults, on the parameter classes of pyspark.ml."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from typing import Any

from pyspark.ml.param import Param, Params

#: Marks a parameter without a default.
UNSET = object()


def one_of(*names: str) -> Callable[[Any], str]:
    """A name of a list, in any case."""

    def convert(v) -> str:
        if (text := str(v).upper()) not in names:
            raise ValueError(f"{v!r} is none of {', '.join(names)}")
        return text

    return convert


def flag(v) -> bool:
    known = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}
    if (text := str(v).lower()) not in known:
        raise ValueError(f"{v!r} is neither true nor false")
    return known[text]


def list_of(kind: Callable[[str], Any]) -> Callable[[Any], list]:
    """Distinct values of a comma separated text or of a list, in their order; at least one."""

    def convert(v) -> list:
        out = list(dict.fromkeys(kind(x) for x in (v.split(",") if isinstance(v, str) else v)))
        if not out:
            raise ValueError("an empty list")
        return out

    return convert


def checked(kind: Callable[[Any], Any], holds: Callable[[Any], bool], said: str) -> Callable[[Any], Any]:
    def convert(v):
        if not holds(out := kind(v)):
            raise ValueError(f"{v!r} is not {said}")
        return out

    return convert


class Parameters(Params):
    """Declared parameters; a value that can't be converted or breaks its check raises ValueError when it is set.

    Subclasses declare in ``__init__`` and state in ``problems`` what values exclude each other.
    """

    def declare(self, name: str, doc: str, kind: Callable[[Any], Any], default: Any = UNSET, required: bool = False) -> None:
        setattr(self, name, Param(self, name, doc, kind))
        self._params = None
        if default is not UNSET:
            self._setDefault(**{name: default})
        self._required = {*getattr(self, "_required", ()), *([name] if required else ())}

    def put(self, **values) -> Parameters:
        """Set by name; underscores may stand for hyphens, None leaves a parameter as it is."""
        for name, v in values.items():
            if v is not None:
                self.set(self.getParam(name if self.hasParam(name) else name.replace("_", "-")), v)
        return self

    def value(self, name: str):
        """The value or the default; None for a parameter with neither."""
        return self.getOrDefault(name) if self.isDefined(name) else None

    def required(self, name: str):
        if not self.isSet(name):
            raise ValueError(f"missing required parameter {name}")
        return self.getOrDefault(name)

    def reset(self) -> None:
        """Unset every value; defaults stay."""
        for p in self.params:
            self.clear(p)

    def problems(self) -> list[str]:
        return []

    def check(self) -> None:
        """Raise ValueError that lists all missing parameters and all broken rules."""
        found = [f"missing required parameter {n}" for n in sorted(self._required) if not self.isSet(n)] + self.problems()
        if found:
            raise ValueError("\n".join(found))

    def parser(self, prog: str) -> argparse.ArgumentParser:
        p = argparse.ArgumentParser(prog=prog, allow_abbrev=False)
        for x in self.params:
            p.add_argument(f"--{x.name}", required=x.name in self._required, help=x.doc.replace("%", "%%"))
        return p

    def parse(self, args: list[str] | None, prog: str) -> Parameters:
        """Values of a command line, checked."""
        self.put(**vars(self.parser(prog).parse_args(args)))
        self.check()
        return self
