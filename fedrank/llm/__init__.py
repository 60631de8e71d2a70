"""Operators for preparing training text at scale.

Every operator takes a DataFrame with at least ``doc_id`` and ``text`` and
returns a DataFrame.  Nothing outside this subpackage imports it.

Conventions shared by all operators (each docstring repeats what differs):

* only ``doc_id`` and ``text`` are read, so extra columns, whatever their names
  or nulls, never matter;
* a null text counts as empty; a row whose ``doc_id`` is null names no document
  and is left out;
* a row that occurs twice gives two equal result rows;
* an empty table gives an empty result with the full schema;
* no text is cut: very long texts are processed whole.
"""
