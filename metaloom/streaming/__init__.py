"""Continuous versions of the profile, sample, budget and upsert operators."""
