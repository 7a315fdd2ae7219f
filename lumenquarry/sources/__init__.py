"""Tables of files, archive members and index snapshots."""
