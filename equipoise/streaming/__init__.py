"""Streaming: intentionally empty.

The source library has no stream source, watermark, window or stateful
operator; every stage runs on a finished table. Run histories are appended in
batches by :mod:`equipoise.sources.sinks` instead.
"""
