"""Text to spans: sentences, measurements, mentions, context, relations, sections.

Offsets are code points, half-open. What needs offsets runs in Python on Arrow
batches; everything that follows is column expressions.
"""
