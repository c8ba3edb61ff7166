"""Readers and writers: bundles, terminology files, exports, source bookkeeping."""
