"""Coarse display facets of specimen and disease wording, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display families in order of precedence, and the wording that names each.
TISSUE_FAMILIES = (
    ("Cell culture / in vitro", r"\bcell lines?\b|\bcell culture\b|\bcultured cells?\b|\blymphoblastoid\b|\borganoid\b"),
    ("Blood & immune", r"\bblood\b|\bbone marrow\b|\bmarrow\b|\blymph(?: node|oid)?\b|\bspleen\b|\bthym(?:us|ic)\b|\btonsil\b|\bleuk(?:ocyte|emia|aemia)\b|\bmononuclear\b|\bpbmc\b|\bmonocyte\b|\bmacrophage\b|\bneutrophil\b|\bplasma cells?\b|\bb cells?\b|\bt cells?\b|\blymphocyte\b|\blymphoblast\b|\blymphoma\b|\bpmn\b|\bhematopoietic\b|\bhaematopoietic\b"),
    ("Respiratory", r"\blung\b|\bairway\b|\bbronch|\balveol|\bpulmon|\btrache|\bpleur|\bnasal\b|\bsputum\b|\bnsclc\b"),
    ("Digestive & hepatobiliary", r"\bcolon(?:ic)?\b|\bcolorectal\b|\brect(?:um|al)\b|\bintestin|\bbowel\b|\bileum\b|\bjejunu|\bduoden|\bstomach\b|\bgastr|\besophag|\boesophag|\bliver\b|\bhepat|\bbile\b|\bbiliary\b|\bgallbladder\b|\bpancrea|\boral\b|\bgingiv|\bsalivary\b|\bsaliva\b"),
    ("Nervous system", r"\bbrain\b|\bcerebr|\bcortex\b|\bcortical\b|\bcerebell|\bhippocamp|\bspinal\b|\bneural\b|\bneuron|\bglia|\bneuroblast|\bglioblast|\bcentral nervous system\b"),
    ("Skin", r"\bskin\b|\bderm|\bepiderm|\bkeratinocyte\b|\bmelanoma\b"),
    ("Breast", r"\bbreast\b|\bmammary\b"),
    ("Reproductive", r"\bovar|\buterus\b|\buterine\b|\bendometri|\bcervix\b|\bectocervix\b|\bvagin|\bvulva|\bplacent|\bprostate\b|\btest(?:is|es|icular)\b|\bsemin"),
    ("Kidney & urinary", r"\bkidney\b|\brenal\b|\bbladder\b|\burinary\b|\bureter\b|\burine\b"),
    ("Musculoskeletal", r"\bskeletal muscle\b|\bmuscle\b|\bvastus lateralis\b|\bmyocyte\b|\bmyoblast\b|\bbone\b|\bcartilage\b|\bchondro|\btendon\b|\bsynovi|\bjoint\b"),
    ("Cardiovascular", r"\bheart\b|\bcardiac\b|\bmyocard|\baorta\b|\barter|\bvascular\b|\bvein\b|\bendotheli"),
    ("Endocrine & metabolic", r"\bthyroid\b|\badrenal\b|\bpituitar|\bislets?\b|\badipose\b|\badipocyte\b"),
    ("Ocular", r"\bretina\b|\bretinal\b|\bcornea\b|\bocular\b|\beye\b"),
)
TISSUE_UNINFORMATIVE = r"^(?:mixed|mixed\s*/\s*unknown|unknown|not reviewed|tissue|organ|anatomical entity|tumou?r(?: biopsy| specimen| tissue)?|frozen tumou?r|cancer,?\s*lcm|various tissues?|multiple tissues?|uberon:[a-z0-9_.-]+(?:\s*/\s*uberon:[a-z0-9_.-]+)*)$"
DISEASE_FAMILIES = (
    ("Neoplastic", r"\bcancer\b|\bcarcinoma\b|\badenocarcinoma\b|\btumou?r\b|\bneoplasm\b|\bleuk(?:a?emia)\b|\blymphoma\b|\bmelanoma\b|\bmyeloma\b|\bsarcoma\b|\bblastoma\b|\bglioma\b|\bglioblastoma\b|\bmesothelioma\b|\bmalignan|\bmyelodysplastic\b"),
    ("Infectious", r"\binfect(?:ion|ious|ed)\b|\bviral\b|\bvirus\b|\bhiv\b|\bhepatitis\b|\binfluenza\b|\btuberculosis\b|\bsepsis\b|\bseptic\b|\bbacter(?:ia|ial)\b"),
    ("Immune & inflammatory", r"\bautoimmune\b|\barthritis\b|\bdermatitis\b|\bpsoriasis\b|\binflamm|\bmultiple sclerosis\b|\bsarcoidosis\b|\bvasculitis\b|\ballerg|\bcrohn|\bcolitis\b|\bco?eliac\b|\blupus\b|\bscleroderma\b"),
    ("Endocrine & metabolic", r"\bdiabet|\bobes|\bmetabolic\b|\binsulin\b|\bthyroid\b|\badrenal\b|\bhyperglyc|\bdyslipid"),
    ("Neurological & mental health", r"\balzheimer|\bparkinson|\bhuntington|\bdementia\b|\bschizophren|\bdepress|\banxiety\b|\bbipolar\b|\bpsychot|\bautis|\bneurolog|\bneuropath|\bepilep|\bmood disorder\b|\bpost-traumatic stress\b"),
    ("Cardiovascular", r"\bcardiomyopath|\bcardiac\b|\bcardiovascular\b|\bcoronary\b|\bmyocard|\batheroscler|\bhypertension\b|\bheart disease\b|\bstroke\b"),
    ("Respiratory", r"\bcopd\b|\bobstructive pulmonary\b|\basthma\b|\bcystic fibrosis\b|\brespiratory\b|\bpulmonary\b|\bairway\b|\bemphysema\b"),
    ("Digestive & hepatic", r"\bcirrhosis\b|\bliver disease\b|\bhepatic disease\b|\bbowel disease\b|\bgastric disease\b|\bpancreatitis\b|\bintestinal disease\b"),
    ("Renal & reproductive", r"\bkidney disease\b|\brenal disease\b|\bnephro|\bendometriosis\b|\binfertil|\bpolycystic ovar|\bpreeclampsia\b"),
    ("Injury & exposure", r"\bburn\b|\binjur|\btrauma\b|\btobacco\b|\bsmoking\b|\birradiat|\bradiation exposure\b|\btoxic|\bexpos(?:ure|ed)\b|\bpoison"),
    ("Reference / no disease", r"\bhealthy\b|\bnormal\b|\bcontrol\b|\breference\b|\bnon-diabetic\b"),
)
DISEASE_UNINFORMATIVE = r"^(?:unknown(?: / not reviewed)?|not reviewed)$"
TISSUE_NAMES = ("Mixed / unspecified", "Other anatomy", "Mixed anatomical systems")
DISEASE_NAMES = ("Unreviewed", "Other / unclassified", "Mixed disease families")
REFERENCE = "Reference / no disease"


def _family(segment: Column, families, uninformative: str, none: str, other: str) -> Column:
    text = F.trim(F.regexp_replace(segment, r"\s+", " "))
    out = F.when((text == "") | text.rlike("(?i)" + uninformative), none)
    for name, pattern in families:
        out = out.when(text.rlike("(?i)" + pattern), name)
    return out.otherwise(other)


def _facet(label: Column, split: str, families, uninformative: str, names, neutral: tuple[str, ...]) -> Column:
    none, other, mixed = names
    parts = F.filter(F.split(F.coalesce(label, F.lit("")), split), lambda x: x != "")
    found = F.array_distinct(F.transform(parts, lambda x: _family(x, families, uninformative, none, other)))
    informative = F.filter(found, lambda x: ~x.isin(none, other, *neutral))
    out = F.when(F.size(informative) > 1, mixed).when(F.size(informative) == 1, F.get(informative, F.lit(0)))
    for name in (*neutral, other):
        out = out.when(F.array_contains(found, name), name)
    return out.otherwise(none)


def tissue_system(label: Column) -> Column:
    """The one informative family of the label's parts; several are mixed, none is other or unspecified."""
    return _facet(label, r"\s*(?:/|;)\s*", TISSUE_FAMILIES, TISSUE_UNINFORMATIVE, TISSUE_NAMES, ())


def disease_family(label: Column) -> Column:
    """As for tissues; a reference or control counts only where no disease is named."""
    return _facet(label, r"\s*;\s*", DISEASE_FAMILIES, DISEASE_UNINFORMATIVE, DISEASE_NAMES, (REFERENCE,))


def group_identity(mode: str, value: Column) -> Column:
    missing = "Unassigned" if mode == "community" else "Unknown"
    shown = F.regexp_replace(value, "^community-0*", "Cluster ")
    return F.concat(F.lit(mode + ":"), F.coalesce(shown, F.lit(missing)))


def _sql(label: str, split: str, families, uninformative: str, names, neutral) -> str:
    none, other, mixed = names
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"when regexp_matches(x, {quote('(?i)' + p)}) then {quote(n)}" for n, p in families)
    found = f"list_distinct(list_transform(list_filter(string_split_regex({label}, {quote(split)}), lambda x: x <> ''), lambda x: case when x = '' or regexp_matches(x, {quote('(?i)' + uninformative)}) then {quote(none)} {whens} else {quote(other)} end))"
    quiet = ", ".join(map(quote, (none, other, *neutral)))
    informative = f"list_filter({found}, lambda y: y not in ({quiet}))"
    rest = " ".join(f"when list_contains({found}, {quote(n)}) then {quote(n)}" for n in (*neutral, other))
    return f"case when len({informative}) > 1 then {quote(mixed)} when len({informative}) = 1 then ({informative})[1] {rest} else {quote(none)} end"


def sql_tissue(label: str) -> str:
    return _sql(label, r"\s*(?:/|;)\s*", TISSUE_FAMILIES, TISSUE_UNINFORMATIVE, TISSUE_NAMES, ())


def sql_disease(label: str) -> str:
    return _sql(label, r"\s*;\s*", DISEASE_FAMILIES, DISEASE_UNINFORMATIVE, DISEASE_NAMES, (REFERENCE,))
