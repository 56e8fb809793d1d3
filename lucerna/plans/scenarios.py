"""Scenarios: named queries over the five public evaluation data sets, and pairs of drifting queries."""

from __future__ import annotations

from ..model import Modality, Predicate, SemCQ, SemPredicate

TEXT, IMAGE, TEXTS, IMAGES = Modality.TEXT, Modality.IMAGE, Modality.VECTOR_TEXT, Modality.VECTOR_IMAGE


def _ask(what: str, condition: str) -> str:
    return f"Decide from the {what} whether this holds: {condition}. Answer true or false."


def _sem(field: str, modality: Modality, condition: str) -> SemPredicate:
    return SemPredicate(field, modality, condition, _ask("text" if modality.is_text else "image", condition))


def _present(*fields: str) -> tuple[Predicate, ...]:
    return tuple(Predicate(f, "!=", "") for f in fields)


_CANCER = Predicate("did_family_have_cancer", "==", 1)

SCENARIOS: dict[str, dict[str, SemCQ]] = {
    "medical": {
        "Q1": SemCQ(("patient_id",), _present("symptoms"), (_sem("symptoms", TEXT, "the patient has an allergy"),)),
        "Q3": SemCQ(("patient_id",), (_CANCER, *_present("image_path_xray")), (_sem("image_path_xray", IMAGE, "the X-ray shows lung problems"),)),
        "Q8": SemCQ(("patient_id",), (_CANCER, *_present("image_path")), (_sem("image_path", IMAGE, "the picture shows a malignant mole"),)),
        "Q9": SemCQ(
            ("patient_id",), _present("image_path", "image_path_xray"),
            (_sem("image_path", IMAGE, "the picture shows a malignant mole"), _sem("image_path_xray", IMAGE, "the X-ray shows a sick lung")),
        ),
    },
    "movie": {
        "Q1": SemCQ(("reviewId",), _present("reviewText"), (_sem("reviewText", TEXT, "the review is clearly positive"),)),
        "Q2": SemCQ(("reviewId",), (Predicate("id", "==", "taken_3"), *_present("reviewText")), (_sem("reviewText", TEXT, "the review is clearly positive"),)),
    },
    "ecomm": {
        "Q1": SemCQ(("id",), _present("productNameAndDesc"), (_sem("productNameAndDesc", TEXT, "the product is a Reebok backpack"),)),
        "Q2": SemCQ(("id",), _present("image_path"), (_sem("image_path", IMAGE, "the picture shows yellow and silver sports shoes"),)),
        "Q13": SemCQ(
            ("id",), _present("productNameAndDesc", "image_path"),
            (_sem("productNameAndDesc", TEXT, "the description is that of a running T-shirt"), _sem("image_path", IMAGE, "the picture shows a running T-shirt")),
        ),
    },
    "animals": {
        "Q7": SemCQ(("City",), _present("ImagePath"), (_sem("ImagePath", IMAGES, "the picture shows a zebra"), _sem("ImagePath", IMAGES, "the picture shows an impala"))),
    },
    "mmqa": {
        **{
            q: SemCQ(("title",), _present("text"), (_sem("text", TEXT, f"the movie is a {kind}"),))
            for q, kind in (("Q3a", "comedy"), ("Q3c", "romance"), ("Q3f", "romantic comedy"), ("Q3g", "biographical comedy"))
        },
        **{
            q: SemCQ(("Airlines",), _present("Destinations"), (_sem("Destinations", m, f"the airline flies to {place}"),))
            for q, m, place in (("Q6a", TEXT, "Frankfurt"), ("Q6b", TEXT, "a place in Germany"), ("Q6c", TEXTS, "a place in Europe"))
        },
    },
}

#: The same questions in other words; each has the truth of the query it rephrases.
PARAPHRASES = {
    "Q3a_p": ("Q3a", "the film belongs to the genre of comedies"),
    "Q3c_p": ("Q3c", "a love story carries the film"),
    "Q3f_p": ("Q3f", "the film counts as a comedy of romance"),
    "Q3g_p": ("Q3g", "the film can be called a comedy about a real life"),
    "Q6a_p": ("Q6a", "Frankfurt is among the airline's destinations"),
    "Q6b_p": ("Q6b", "some destination of the airline lies in Germany"),
    "Q6c_p": ("Q6c", "the airline serves European destinations"),
}

DRIFT_GROUPS: dict[str, list[tuple[str, str]]] = {
    "paraphrase": [(q, f"{q}_p") for q in ("Q3a", "Q3f", "Q3g", "Q6a", "Q6b", "Q6c")],
    "recombine": [("Q3f", "Q3a"), ("Q3f", "Q3c"), ("Q3g", "Q3a")],
    "unseen": [("Q3a", "Q3f"), ("Q3c", "Q3f"), ("Q3a", "Q3g")],
    "revision": [(a, b) for a in ("Q6a", "Q6b", "Q6c") for b in ("Q6a", "Q6b", "Q6c") if a != b],
}


def available() -> list[str]:
    return sorted(SCENARIOS)


def queries_of(scenario: str, names: list[str] | None = None) -> dict[str, SemCQ]:
    """The queries of a scenario; unknown names are an error."""
    if scenario not in SCENARIOS:
        raise ValueError(f"scenario: one of {available()}")
    known = SCENARIOS[scenario] | (paraphrased() if scenario == "mmqa" else {})
    unknown = set(names or ()) - set(known)
    if unknown:
        raise ValueError(f"unknown queries {sorted(unknown)}")
    return {n: known[n] for n in (names or SCENARIOS[scenario])}


def paraphrased() -> dict[str, SemCQ]:
    out = {}
    for name, (first, condition) in PARAPHRASES.items():
        q = SCENARIOS["mmqa"][first]
        out[name] = SemCQ(q.selected, q.sigma, (_sem(q.semantics[0].field, q.semantics[0].modality, condition),))
    return out


def truth_name(query: str) -> str:
    """The query whose truth a query has: a paraphrase shares that of its first form."""
    return PARAPHRASES.get(query, (query,))[0]
