"""Conversation-corpus building and text evaluation as Spark DataFrame operators."""
