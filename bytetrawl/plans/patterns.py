"""Pattern sets: patterns with options and encodings, the labels that they make, and their errors."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from bytetrawl.functions import encodings

from . import emit, parser

DEFAULT_ENCODING = "US-ASCII"
FORMAT = 1


@dataclass(frozen=True)
class Label:
    """A pattern in an encoding; keyword_index is its place among all labels."""

    keyword_index: int
    user_index: int
    pattern: str
    enc_chain: str
    options: parser.Options

    @property
    def tree(self) -> parser.Node:
        return parser.parse(self.pattern, self.options)


@dataclass(frozen=True)
class Problem:
    """Why a pattern, or one of its encodings, was left out. index: the pattern's place in its list, or -1."""

    message: str
    pattern: str
    enc_chain: str
    source: str
    index: int

    def __str__(self) -> str:
        return (f"{self.source}, " if self.source else "") + f"pattern {self.index} {self.pattern} {self.enc_chain}: {self.message}"


@dataclass
class PatternSet:
    """Labels in the order in which they were added, and the errors of those that couldn't be."""

    labels: list[Label] = field(default_factory=list)
    errors: list[Problem] = field(default_factory=list)

    def add(self, pattern: str, chains: Iterable[str] = (DEFAULT_ENCODING,), options: parser.Options = parser.Options(), user_index: int = 0, source: str = "", index: int = -1) -> PatternSet:
        """Add a pattern in each encoding. Each encoding that fails is an error of its own; the others stay."""
        for chain in chains:
            try:
                name = encodings.parse_chain(chain)[2]
                emit.byte_regex(parser.parse(pattern, options), name)
            except (parser.PatternError, encodings.EncodingError) as e:
                self.errors.append(Problem(str(e), pattern, chain, source, index))
                continue
            self.labels.append(Label(len(self.labels), user_index, pattern, name, options))
        return self

    def add_list(self, text: str, source: str = "", chains: Iterable[str] = (DEFAULT_ENCODING,), options: parser.Options = parser.Options()) -> PatternSet:
        """Add the lines of a pattern file: pattern, encodings (by commas), fixed, case-insensitive and Unicode (0 or 1), between tabs; all but the pattern can be left out.

        Lines that are empty don't count, and runs of tabs are one. The user index is the line's number.
        """
        for i, line in enumerate(x for x in re.split(r"[\r\n]+", text) if x):
            cells = [c for c in line.split("\t") if c]
            if not cells:
                continue
            flags = [c.strip() for c in cells[2:5]]
            if any(f not in ("0", "1") for f in flags):
                self.errors.append(Problem("bad option: " + next(f for f in flags if f not in ("0", "1")), cells[0], cells[1] if len(cells) > 1 else "", source, i))
                continue
            own = parser.Options(*[f == "1" for f in flags], *[getattr(options, n) for n in ("fixed", "case_insensitive", "unicode")[len(flags) :]])
            self.add(cells[0], [c for c in cells[1].split(",") if c] if len(cells) > 1 else chains, own, i, source, i)
        return self

    @classmethod
    def from_list(cls, patterns: Iterable[str | tuple], chains: Iterable[str] = (DEFAULT_ENCODING,), options: parser.Options = parser.Options()) -> PatternSet:
        """Patterns, or (pattern, chains, options) tuples; the user index is the place in the list."""
        out = cls()
        for i, p in enumerate(patterns):
            pattern, own, opts = (p, chains, options) if isinstance(p, str) else (*p, *(chains, options)[len(p) - 1 :])
            out.add(pattern, own, opts, i, index=i)
        return out

    @classmethod
    def from_encase(cls, patterns: Iterable[str], **more: object) -> PatternSet:
        """Patterns in a forensic tool's notation: # is a digit, \\whhhh a code point, and * and + end at 255 turns."""
        def change(p: str) -> str:
            p = re.sub(r"(?<!\\)#", r"\\d", p)
            p = re.sub(r"\\w([0-9A-Fa-f]{4})", r"\\x{\1}", p)
            p = re.sub(r"(?<!\\)\*", "{0,255}", p)
            return re.sub(r"(?<!\\)\+", "{1,255}", p)

        return cls.from_list([change(p) for p in patterns], **more)  # type: ignore[arg-type]

    def check(self) -> PatternSet:
        """The set itself; ValueError if it has no labels."""
        if not self.labels:
            raise ValueError("No valid patterns were parsed" + "".join(f"\n{e}" for e in self.errors))
        return self

    def info(self, spark: SparkSession) -> DataFrame:
        """The labels as a table."""
        rows = [(x.keyword_index, x.user_index, x.pattern, x.enc_chain, x.options.fixed, x.options.case_insensitive, x.options.unicode) for x in self.labels]
        return spark.createDataFrame(rows, "keyword_index int, user_index long, pattern string, enc_chain string, fixed boolean, case_insensitive boolean, unicode boolean")

    def error_table(self, spark: SparkSession) -> DataFrame:
        """The errors as a table."""
        return spark.createDataFrame([(e.message, e.pattern, e.enc_chain, e.source, e.index) for e in self.errors], "message string, pattern string, enc_chain string, source string, index int")

    def to_json(self) -> str:
        """A form to keep; from_json reads it."""
        return json.dumps({"format": FORMAT, "labels": [asdict(x) for x in self.labels]})

    @classmethod
    def from_json(cls, text: str) -> PatternSet:
        data = json.loads(text)
        if data.get("format") != FORMAT:
            raise ValueError("a pattern set of another format")
        return cls([Label(**(x | {"options": parser.Options(**x["options"])})) for x in data["labels"]])

    def save(self, spark: SparkSession, path: str) -> None:
        """Keep the set as a table of one row."""
        spark.createDataFrame([(self.to_json(),)], "program string").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PatternSet:
        return cls.from_json(spark.read.parquet(path).first().program)

    def listing(self) -> str:
        """The programs of all labels."""
        return "\n".join(f"# {x.keyword_index} {x.pattern} {x.enc_chain}\n{emit.program(x.tree, x.enc_chain).listing()}" for x in self.labels)
