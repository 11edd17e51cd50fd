"""Operators for building a training corpus: mixing, chat formatting, decontamination, toxicity,
near-duplicates, licences, url filters, quality and secret scans.

Every module holds one operator with a general ``DataFrame -> DataFrame`` interface; ``queries``
registers the thin queries over the given tables and ``sql`` their SQL twins. Nothing outside this
package imports it.
"""
