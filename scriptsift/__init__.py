"""Leak and risk scanning of captured web assets on Spark."""
