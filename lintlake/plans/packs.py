"""Registry of language packs: how users add a language without touching the library."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lintlake.operators.corpus import LANGUAGE_BY_SUFFIX
from lintlake.operators.fact_rules import FACT_RULES, FactRule
from lintlake.operators.file_rules import FILE_RULES, FileRule
from lintlake.operators.rulebook import LINE_RULES, LineRule
from lintlake.plans.scan import Pack, scan_all


@dataclass
class PackRegistry:
    """Suffixes, line, file and syntax rules and array rules, used together by :meth:`scan`."""

    extensions: dict[str, str] = field(default_factory=lambda: dict(LANGUAGE_BY_SUFFIX))
    rules: list[LineRule] = field(default_factory=lambda: list(LINE_RULES))
    packs: dict[str, Pack] = field(default_factory=dict)
    fact_rules: list[FactRule] = field(default_factory=lambda: list(FACT_RULES))
    file_rules: list[FileRule] = field(default_factory=lambda: list(FILE_RULES))

    def register(
        self,
        language: str,
        suffixes: list[str] | None = None,
        rules: list[LineRule] | None = None,
        pack: Pack | None = None,
        fact_rules: list[FactRule] | None = None,
        file_rules: list[FileRule] | None = None,
    ) -> None:
        """Adds a language, or more suffixes and rules to one that is there.

        Syntax rules are for Python, whose files are the only ones that are parsed.
        """
        if fact_rules and language != "python":
            raise ValueError("syntax rules look at Python files only")
        if any(rule.language != language for rule in [*(rules or []), *(file_rules or [])]):
            raise ValueError(f"a rule is for another language than {language}")
        for suffix in suffixes or []:
            self.extensions[suffix] = language
        self.rules.extend(rules or [])
        self.fact_rules.extend(fact_rules or [])
        self.file_rules.extend(file_rules or [])
        if pack is not None:
            self.packs[language] = pack

    def scan(self, files: DataFrame, *keep: str, max_bytes: int | None = None) -> DataFrame:
        return scan_all(
            files,
            rules=self.rules,
            packs=self.packs,
            extensions=self.extensions,
            keep=keep,
            max_bytes=max_bytes,
            fact_rules=self.fact_rules,
            file_rules=self.file_rules,
        )
