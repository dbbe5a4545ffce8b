"""From input tables to each published table, as lazy DataFrames.

``District`` wires operators together and holds no data.  Any number of snapshot
days run in one job: the day is part of every grouping and join key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from roomledger.config import Rules
from roomledger.operators import cells, enrollment, errors, metrics, refdata, reports, rooms
from roomledger.plans.staging import Staging
from roomledger.sources import Inputs


@dataclass(frozen=True)
class District:
    inputs: Inputs
    rules: Rules = field(default_factory=Rules)
    #: Student cells split by grade, if they have been staged; else they are made from students.
    own_cells: DataFrame | None = None
    #: School years of the snapshot days, to read no others; all if not named.
    school_years: tuple[str, ...] | None = None

    # -- students -----------------------------------------------------------

    def enrolled(self) -> DataFrame:
        i = self.inputs
        return enrollment.enrollment(i.students, i.split_schools, i.program_codes, self.rules)

    def enrolled_with_span(self) -> DataFrame:
        return enrollment.with_dob_span(self.enrolled(), self.inputs.students, self.rules)

    # -- cells and rooms ----------------------------------------------------

    def student_cells(self, *extra_keys: str) -> DataFrame:
        if self.own_cells is not None:
            return self.own_cells
        return cells.student_cells(self.inputs.students, self.rules, *extra_keys)

    def cells(self, *extra_keys: str) -> DataFrame:
        i = self.inputs
        own = self.student_cells(*extra_keys)
        return cells.decoded_cells(own, i.split_schools, i.program_codes, self.rules)

    def type_counts(self) -> DataFrame:
        return cells.type_counts(self.cells())

    def room_totals(self, trace_errors: bool = False) -> DataFrame:
        """One row per room; with ``trace_errors`` it also carries the usual grade and the
        dominant class types of its homeroom code."""
        if trace_errors:
            return rooms.room_totals(cells.with_mode_grade(self.cells("grade")))
        return rooms.room_totals(self.cells())

    def room_base(self, trace_errors: bool = False) -> DataFrame:
        i = self.inputs
        return rooms.room_base(
            self.room_totals(trace_errors),
            refdata.limit_group_by_type(i.program_codes, self.rules),
            refdata.class_limits(i.class_limits, i.program_codes, self.rules),
            i.school_names,
            self.rules,
        )

    def measured_rooms(self, trace_errors: bool = False) -> DataFrame:
        """All rooms with limits and shares, before paper rooms are left out."""
        capped = metrics.with_ratio_caps(
            self.room_base(trace_errors), self.inputs.inclusion_ratios
        )
        return metrics.with_sped_share(metrics.with_capacity(capped, self.rules), self.rules)

    def report_rooms(self, trace_errors: bool = False) -> DataFrame:
        """The rooms every report is made from."""
        real = metrics.real_rooms(self.measured_rooms(trace_errors), self.rules)
        return metrics.with_flags(real, self.rules)

    # -- errors -------------------------------------------------------------

    def known_types(self) -> DataFrame:
        used = self.own_cells
        if used is None:  # two narrow columns of the students say as much
            students = enrollment.in_scope(self.inputs.students, self.rules)
            used = enrollment.with_program_code(students, self.rules)
        return errors.known_types(used, self.inputs.program_codes)

    def error_rooms(
        self, traced_rooms: DataFrame | None = None, types: DataFrame | None = None
    ) -> DataFrame:
        """Rooms in error, from given (staged) rooms and types or worked out on the way."""
        found = self.report_rooms(trace_errors=True) if traced_rooms is None else traced_rooms
        return errors.error_rooms(found, self.known_types() if types is None else types, self.rules)

    def error_codes(
        self, traced_rooms: DataFrame | None = None, types: DataFrame | None = None
    ) -> DataFrame:
        return errors.error_codes(self.error_rooms(traced_rooms, types))

    def misplaced_students(self, codes: DataFrame) -> DataFrame:
        """Students to check under the given :meth:`error_codes`.

        Pass codes that have been staged: the planner then knows how few they are
        and filters students where they are read.  With unstaged codes it has to
        shuffle every student before it can know.
        """
        return errors.misplaced_students(
            self.enrolled(), codes, self.inputs.school_names, self.rules
        )

    # -- published tables ---------------------------------------------------

    def capacities(self) -> DataFrame:
        """Recorded capacities of the school years in question; of all years if none are named."""
        return refdata.capacity_crosswalk(
            self.inputs.homeroom_crosswalk, self.inputs.structure_data, self.school_years
        )

    def student_list(self) -> DataFrame:
        return reports.sorted_student_list(self.enrolled(), self.inputs.school_names)

    def capacity_sheet(self) -> DataFrame:
        return reports.capacity_sheet(self.report_rooms())

    def district_report(self) -> DataFrame:
        return reports.district_report(self.report_rooms(), self.capacities())

    def school_report(self) -> DataFrame:
        return reports.school_report(self.report_rooms(), self.capacities(), self.rules)

    def student_errors(self, staging: Staging) -> DataFrame:
        codes = staging.keep(self.error_codes(), "error_codes")
        return reports.student_errors(self.misplaced_students(codes))
