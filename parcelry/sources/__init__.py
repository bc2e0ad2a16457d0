"""Reading and writing: tables, files of documents, exports."""
