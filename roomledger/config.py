"""District rules.  Every number, code and label that is policy rather than logic."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values.  They have to equal the district's own codes and spellings
# (misspellings included) for results to match, so they are listed as they are.
# ---------------------------------------------------------------------------

EXCLUDED_SCHOOL = 3003
IGNORED_CAMPUS_MERGES = (4171, 4650, 4391)
MULTIGRADE_SCHOOL = 4321
SMALL_SPED_SCHOOL = 4610
UNPUBLISHED_SCHOOLS = (1290,)

NO_LIMIT_GROUP = "AIM"
INCLUSION_GROUP = "SI4"
PARA_BY_DEFAULT_GROUPS = ("SL4", "SF4", "SA4")
SEI_GROUP_PATTERN = "BL[A-Z]"

HOMEROOM_GRADES = (0, 1, 2, 7, 8)
REGULAR_TYPES = ("Homeroom", "Gen Ed", "Inclusion")
RENAMED_TYPES = ("Homeroom", "ABA")
EXEMPT_TYPES = (
    "Autism",
    "Early Childhood Center-Based",
    "Emotional Impairment",
    "Hearing Impairment",
    "Mild Intellectual Impairment",
    "Moderate Intellectual Impairment",
    "Multiple Disabilities",
    "Severe Intellectual Impairment",
    "Specific Learning Disability",
    "Hatian SLIFE",
    "Cape Verdean SLIFE",
    "Spanish SLIFE",
    "Multilingual SLIFE",
)
MIXED_SEI_LABEL = "Multiligual SEI"

PROGRAM_TYPES = ("gened", "inclusion", "subsep", "sei", "bilingual")
ELD_LEVELS = ("1", "2", "3", "4", "5")

SLIFE_LIMIT = 15
YOUNG_GRADES = "K0 to K1"
MIXED_SLIFE_PATTERN = "SLIFE.*SLIFE"
# A class type's name, and the part of it that reports show instead.
SHOWN_AS = ("Autism", "ABA")
# Rooms of fewer general-education students go by their SEI type.
FEW_GENERAL = 3
# Rooms on paper: from how many students on, of exactly how many, and regular and special ones up to how many.
TOO_MANY, SINGLE, TINY_REGULAR, TINY_SPED = 40, 1, 5, 2
# Shares of students with a plan, of the room and of the contract limit, from which an issue is flagged.
NEAR_HALF, HALF = 0.45, 0.5
NEAR_BTU, OVER_BTU = 0.35, 0.40
DAYS_PER_MONTH = 30.416666
# (lowest grade below, contractual limit on students with a special-education plan)
BTU_LIMITS = ((0, 20), (3, 22), (6, 23), (9, 25))

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """The rule set one job runs under; pass a changed copy to try another policy."""

    excluded_school: int = EXCLUDED_SCHOOL
    ignored_campus_merges: tuple[int, ...] = IGNORED_CAMPUS_MERGES
    multigrade_school: int = MULTIGRADE_SCHOOL
    small_sped_school: int = SMALL_SPED_SCHOOL
    unpublished_schools: tuple[int, ...] = UNPUBLISHED_SCHOOLS

    no_limit_group: str = NO_LIMIT_GROUP
    inclusion_group: str = INCLUSION_GROUP
    para_by_default_groups: tuple[str, ...] = PARA_BY_DEFAULT_GROUPS
    sei_group_pattern: str = SEI_GROUP_PATTERN

    homeroom_grades: tuple[int, ...] = HOMEROOM_GRADES
    regular_types: tuple[str, ...] = REGULAR_TYPES
    renamed_types: tuple[str, ...] = RENAMED_TYPES
    exempt_types: tuple[str, ...] = EXEMPT_TYPES
    mixed_sei_label: str = MIXED_SEI_LABEL

    slife_limit: int = SLIFE_LIMIT
    young_grades: str = YOUNG_GRADES
    mixed_slife_pattern: str = MIXED_SLIFE_PATTERN
    shown_as: tuple[str, str] = SHOWN_AS
    few_general: int = FEW_GENERAL
    too_many: int = TOO_MANY
    single: int = SINGLE
    tiny_regular: int = TINY_REGULAR
    tiny_sped: int = TINY_SPED
    near_half: float = NEAR_HALF
    half: float = HALF
    near_btu: float = NEAR_BTU
    over_btu: float = OVER_BTU
    days_per_month: float = DAYS_PER_MONTH
    btu_limits: tuple[tuple[int, int], ...] = BTU_LIMITS
