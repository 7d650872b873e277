"""The full scan of a fleet: source files in, drift report out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrift.operators import definitions, drift, files, report, usages
from keydrift.operators.skew import hot_groups
from keydrift.plans.staging import Staging
from keydrift.sources.rules import RULES_FILE, read_ignore_rules


@dataclass(frozen=True)
class ScanOptions:
    """What a scan can be told; the same for every repository of the fleet."""

    extra_env_files: tuple[str, ...] = ()
    auto_detect: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    skip_unused: bool = False
    no_dynamic: bool = False
    rules_file: str = RULES_FILE
    rows_per_document: int | None = None


class DriftScan:
    """Results over ``source_files`` (repo_id, path, content) and exported names (repo_id, key).

    Nothing runs until a result is asked for; asking starts the jobs that write what it stands on.
    Text is read twice at most, once as code and once as config, in narrow
    projections that never shuffle it. The small tables that several results
    read (``found``, ``usages``, ``env``, ``ledger``, ``groups``) are written once, in a
    folder of the scan's own that ``close`` removes; results that were not read
    before are gone with it. No table holds a variable's value as it is: what is
    written is redacted.
    """

    def __init__(
        self,
        source_files: DataFrame,
        exported: DataFrame,
        rules: DataFrame | None = None,
        options: ScanOptions = ScanOptions(),
    ) -> None:
        self.source_files = source_files
        self.exported = exported
        self.options = options
        self.rules = rules if rules is not None else read_ignore_rules(source_files, options.rules_file)

    def __enter__(self) -> DriftScan:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @cached_property
    def staging(self) -> Staging:
        return Staging(self.source_files.sparkSession, "scan")

    @cached_property
    def lookups(self) -> Staging:
        """For the ignore rules and the tables that only the search for contained expressions reads."""
        return Staging(self.source_files.sparkSession, "lookups")

    def close(self) -> None:
        """Remove all written tables."""
        for name in ("staging", "lookups"):
            if name in self.__dict__:
                getattr(self, name).close()

    # ------------------------------------------------------------ inputs

    @cached_property
    def code_files(self) -> DataFrame:
        return files.code_files(self.source_files, self.options.include, self.options.exclude)

    @cached_property
    def hot_repos(self) -> DataFrame:
        counts = self.source_files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
        return hot_groups(counts, ["repo_id"])

    @cached_property
    def scanned_files(self) -> DataFrame:
        """Scanned paths with language and ``in_ignored_path``; contents are not read."""
        narrow = self.code_files.select("repo_id", "path", "language")
        return files.apply_folder_rules(narrow, self.read_rules, self.hot_repos)

    @cached_property
    def env_files(self) -> DataFrame:
        return definitions.select_env_files(
            self.source_files, self.options.extra_env_files, self.options.auto_detect
        )

    # ------------------------------------------------------------ staged tables

    @cached_property
    def read_rules(self) -> DataFrame:
        """The ignore rules: every rules file is read and parsed once, however many results ask for it."""
        return self.lookups.stage(self.rules, "rules")

    @cached_property
    def usages(self) -> DataFrame:
        found = self.staging.stage(usages.extract_usages(self.code_files), "found")
        # what is spread is counted: a repository of few files may have very many usages
        counts = found.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
        flagged = files.apply_folder_rules(found, self.read_rules, hot_groups(counts, ["repo_id"]), "file", ["file", "line"])
        return self.staging.stage(flagged, "usages")

    @cached_property
    def definitions(self) -> DataFrame:
        return definitions.parse_definitions(self.env_files)

    @cached_property
    def env(self) -> DataFrame:
        merged = definitions.overlay_exported(self.definitions, self.exported)
        return self.staging.stage(definitions.redacted(merged), "env")

    @cached_property
    def ledger(self) -> DataFrame:
        return self.staging.stage(drift.key_ledger(drift.key_profile(self.usages), self.env, self.read_rules), "ledger")

    # ------------------------------------------------------------ results

    @cached_property
    def missing(self) -> DataFrame:
        return drift.missing(self.usages, self.ledger)

    @cached_property
    def reported_groups(self) -> DataFrame:
        partial = self.lookups.stage(drift.partial_groups(self.usages), "partial")
        return self.staging.stage(drift.reported_groups(partial, self.env, self.lookups.stage), "groups")

    @cached_property
    def partial_matches(self) -> DataFrame:
        return drift.partial_matches(self.usages, self.reported_groups)

    @cached_property
    def unused(self) -> DataFrame:
        return drift.unused(self.ledger)

    @cached_property
    def summary(self) -> DataFrame:
        repos = self.source_files.select("repo_id")
        flags = self.options.skip_unused, self.options.no_dynamic
        return drift.summarize(repos, self.ledger, self.reported_groups, *flags)

    @cached_property
    def report_rows(self) -> DataFrame:
        flags = self.options.skip_unused, self.options.no_dynamic
        return report.report_rows(self.missing, self.partial_matches, self.unused, *flags)

    @cached_property
    def staged_report(self) -> DataFrame:
        """The report rows written once, for results that read them more than once."""
        return self.staging.stage(self.report_rows, "report")

    @cached_property
    def json_lines(self) -> DataFrame:
        """The report in the layout for every size: one line for each listed place, one for each repository."""
        return report.json_lines(self.report_rows, self.summary)

    @cached_property
    def json_report(self) -> DataFrame:
        """The nested view: a document per repository, or several where ``rows_per_document`` asks for it."""
        return report.json_report(self.staged_report, self.summary, self.options.rows_per_document)

    @cached_property
    def json_fragments(self) -> DataFrame:
        """The nested documents in fragments, for repositories of any size; see ``report.write_documents``."""
        return report.json_fragments(report.sorted_parts(self.staged_report, self.summary, self.staging.stage))
