"""Closed vocabularies."""

#: Labels of an adjudicated decision and of a pair.
STATUS_LABELS = ["decision", "no_decision", "compuesta", "sin_soporte", "descartar"]
RELATION_LABELS = ["introduce", "reafirma", "refina", "revierte", "reemplaza", "no_relacionada"]
#: Relations that tie two decisions.
TYING_RELATIONS = ["reafirma", "refina", "revierte", "reemplaza"]
