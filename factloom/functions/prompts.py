"""Which prompts an annotation belongs to, by the patterns of each."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from factloom.functions.text import stripped
from factloom.operators.patterns import Finder, needed

#: The patterns that tell each prompt's annotations, in the order in which prompts are tried.
PROMPT_PATTERNS = {
    "gender-int": [r"^patient\'?s gender", r"^gender"],
    "biopsygrading-int": [r"biopsy grading.*fnclcc", r"^biopsy grading"],
    "surgerymargins-int": [r"^margins after surgery", r"^margins"],
    "tumordepth-int": [r"^tumor depth"],
    "biopsymitoticcount-int": [r"^biopsy mitotic count", r"unknown biopsy mitotic count"],
    "reexcision-int": [r"re-?excision", r"radicalization"],
    "necrosis_in_biopsy-int": [r"necrosis in biopsy"],
    "previous_cancer_treatment-int": [r"^previous cancer treatment", r"no previous cancer"],
    "chemotherapy_start-int": [r"chemotherapy.*started on", r"pre-operative chemotherapy", r"post-operative chemotherapy"],
    "surgerytype-fs30-int": [r"^primary surgery was performed", r"^surgery was performed", r"^surgery was not performed"],
    "radiotherapy_start-int": [r"radiotherapy.*started", r"pre-operative radiotherapy", r"post-operative radiotherapy"],
    "recurrencetype-int": [r"^type of recurrence", r"recurrence/progression"],
    "radiotherapy_end-int": [r"radiotherapy.*ended on", r"radiotherapy in total of"],
    "tumorbiopsytype-int": [r"baseline/primary tumor.*biopsy has been performed", r"biopsy has been performed"],
    "necrosis_in_surgical-int": [r"necrosis in surgical"],
    "tumordiameter-int": [r"^tumor longest diameter", r"tumor longest diameter unknown"],
    "patient-status-int": [r"^status of the patient", r"last follow-up"],
    "response-to-int": [r"^response to.*radiotherapy", r"^response to.*chemotherapy"],
    "stage_at_diagnosis-int": [r"^stage at diagnosis", r"unknown.*stage at diagnosis", r"unknown stage"],
    "chemotherapy_end-int": [r"chemotherapy ended on", r"pre-operative chemotherapy ended", r"post-operative chemotherapy ended"],
    "occurrence_cancer-int": [r"^occurrence of other cancer", r"^no previous or concurrent cancers", r"no information about occurrence"],
    "surgical-specimen-grading-int": [r"surgical specimen grading.*fnclcc", r"^surgical specimen grading"],
    "ageatdiagnosis-int": [r"^age at diagnosis"],
    "recur_or_prog-int": [r"^there was.*progression", r"^there was.*recurrence", r"no progression/recurrence"],
    "histological-tipo-int": [r"^histological type", r"icd-o-3"],
    "surgical-mitotic-count-int": [r"^surgical specimen mitotic count", r"unknown surgical specimen mitotic count"],
    "tumorsite-int": [r"^tumor site"],
}


class PromptFinder:
    """Prompts by their lists of patterns; only patterns whose needed letters an automaton finds are tried."""

    def __init__(self, rules: dict[str, list[str]]):
        self.prompts = list(rules)
        pairs = [(k, p) for k, some in enumerate(rules.values()) for p in some]
        self.owners = [k for k, _ in pairs]
        self.patterns = [re.compile(p, re.IGNORECASE) for _, p in pairs]
        self.finder = Finder([needed(p) for _, p in pairs])

    def find(self, text: str) -> list[str]:
        """The prompts of a text (in lower case, without white space at its ends), in their order."""
        found: list[int] = []
        for i in self.finder.candidates(text):
            if (not found or found[-1] != self.owners[i]) and self.patterns[i].search(text):
                found.append(self.owners[i])
        return [self.prompts[k] for k in found]


def prompts_of(annotation: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """The prompts that have a pattern in an annotation, in the order of the rules; none for a null one.

    How many prompts and patterns there are does not change the plan, and hardly the time, as those that cannot match are not tried.
    """
    rules = PROMPT_PATTERNS if rules is None else rules

    @F.pandas_udf(ArrayType(StringType()))
    def find(texts: pd.Series) -> pd.Series:
        finder = PromptFinder(rules)
        known = {t: finder.find(t) for t in texts.dropna().unique()}
        return texts.map(lambda t: known.get(t, []))

    return find(stripped(F.lower(annotation)))


def shown_prompts(mapped: Column, exclusions: Column, overrides: Column) -> Column:
    """The prompts of a note as a reviewer's page has them: those mapped to its report type (none without a mapping) but for the exclusions,
    then the overrides that are not among them. So a prompt that is excluded and added stays, other than where exclusions come last."""
    none = F.array().cast("array<string>")
    kept = F.filter(F.coalesce(mapped, none), lambda p: ~F.array_contains(F.coalesce(exclusions, none), p))
    return F.concat(kept, F.filter(F.array_distinct(F.coalesce(overrides, none)), lambda p: ~F.array_contains(kept, p)))
