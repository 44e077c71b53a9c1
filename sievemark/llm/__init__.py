"""Operators of a training-data pipeline: cleaning, archives, packing, languages, neighbours, ids, mixing, copies, licences, personal data."""
