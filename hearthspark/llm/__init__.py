"""Corpus-preparation operators for training data, each one a DataFrame -> DataFrame job.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
