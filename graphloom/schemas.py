"""Record types and vocabularies of the typed graph."""

from __future__ import annotations

from pyspark.sql import types as T

#: Types of nodes and edges, and which of them study or work.
NODE_TYPES = (
    "school_stage", "stream", "exam", "degree", "diploma", "certification", "training", "job_role",
    "government_service", "entrepreneurship",
)
EDGE_TYPES = ("progression", "exam_gate", "lateral")
EDUCATION_TYPES = ("school_stage", "stream", "degree", "diploma", "certification", "training")
WORKING_TYPES = ("job_role", "government_service", "entrepreneurship")

#: Ordered whole-token replacements of title normalisation.
ABBREVIATIONS = (
    ("govt", "government"), ("pvt", "private"), ("ph d", "phd"), ("post doctoral", "postdoctoral"),
    ("dept", "department"), ("mgmt", "management"), ("engg", "engineering"), ("tech", "technology"),
    ("admn", "administration"), ("counselor", "counsellor"), ("pediatric", "paediatric"),
    ("specialty", "speciality"), ("psus", "psu"),
)
#: Tokens that tell levels of a role apart.
LEVEL_TOKENS = (
    "junior", "senior", "lead", "principal", "chief", "head", "deputy", "vice", "assistant", "associate",
    "trainee", "intern", "bachelor", "master", "doctoral", "phd", "postdoctoral", "b", "m", "ug", "pg", "dm",
    "mch", "md", "ms",
)
#: Normalised titles that mean nothing without their parent.
BARE_GENERICS = (
    "phd", "ph d", "doctor of philosophy", "masters", "master s", "higher studies", "specialization",
    "specialisation", "postdoc", "research", "further studies", "m tech", "m sc", "m a", "mba abroad",
)
#: Section keys that several types share.
_STUDY = ("eligibility", "duration", "curriculum", "admission", "costs", "next_options")
_WORK = ("responsibilities", "entry_routes", "skills", "workplace", "progression", "compensation_context")
_SCHOOL = ("subjects", "selection_considerations", "future_routes")
#: Section keys that a fact document of each type may have.
SECTION_KEYS = {
    "degree": _STUDY, "diploma": _STUDY, "certification": _STUDY, "training": _STUDY,
    "exam": ("purpose", "eligibility", "format", "application_process", "preparation", "outcomes"),
    "job_role": _WORK, "government_service": _WORK,
    "entrepreneurship": ("entry_routes", "capabilities", "operating_model", "compliance", "growth_paths"),
    "school_stage": _SCHOOL, "stream": _SCHOOL,
}
STABLE_ID = r"^(?:" + "|".join(NODE_TYPES) + r"):[a-z0-9]+(?:-[a-z0-9]+)*$"

_STRINGS = T.ArrayType(T.StringType())
_PROV = "struct<model:string,prompt_version:string,generated_at:string,source_urls:array<string>>"
FACTS = (
    "struct<schema_version:int,last_reviewed:string,"
    "quick_facts:array<struct<label:string,value:string,source_urls:array<string>>>,"
    "sections:array<struct<key:string,heading:string,paragraphs:array<string>,bullets:array<string>,"
    "source_urls:array<string>>>,useful_links:array<struct<label:string,url:string,kind:string>>,"
    "prov:struct<model:string,prompt_version:string,generated_at:string>>"
)
NODE = (
    "id string, type string, title string, aliases array<string>, description string, is_terminal boolean, "
    f"needs_review boolean, facts {FACTS}, prov {_PROV}"
)
EDGE = f"id string, from_id string, to_id string, edge_type string, is_common_route boolean, prov {_PROV}"
FRONTIER = "id string, depth int, pos long, expanded boolean"
LEDGER = (
    "date string, action string, title string, type string, node_id string, score double, reason string, "
    "judge_model string, candidates array<struct<id:string,score:double>>"
)
AUDIT = "url string, status int, error string, reachable boolean, definitive_failure boolean"
