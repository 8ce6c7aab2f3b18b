"""Predicate language: text to postfix program to one Spark column."""
