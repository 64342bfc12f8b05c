"""Structured Streaming jobs over a circulation feed (event_id, ts, book_id, member_id, action)."""
