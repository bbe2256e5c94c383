"""DataFrame operators: metadata, dates, people, edits, captions, identity, text blocks, batches, reports."""
