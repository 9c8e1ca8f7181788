"""Streams: counts in windows of event time, running records by key. An extension: the batch queries don't need it."""
