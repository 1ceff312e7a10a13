"""Storefront search and shopper analytics as Spark DataFrame operators."""
