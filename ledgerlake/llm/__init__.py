"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``registry`` lists the queries that apply them to whole tables."""
