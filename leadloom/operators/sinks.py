"""Writers. An empty table writes nothing."""

import uuid

from leadloom.operators.batches import write_batch
from leadloom.operators.leads import clean_leads, dedupe_leads, export_columns


def nonempty(df):
    return not df.isEmpty()


def write_leads(df, path, mode="overwrite"):
    """Cleaned, deduplicated leads in export order as CSV. False if there was nothing to write."""
    if not nonempty(df):
        return False
    rows = export_columns(dedupe_leads(clean_leads(df)))
    rows.write.mode(mode).csv(path, header=True, quote='"', escape='"')
    return True


def write_scored(df, path, file_format="csv", mode="overwrite"):
    """Scored leads as CSV with a header, or in any other file format."""
    if not nonempty(df):
        return False
    options = {"header": True, "quote": '"', "escape": '"'} if file_format == "csv" else {}
    df.write.mode(mode).format(file_format).options(**options).save(path)
    return True


def append_log(entries, path, batch_id=None):
    """Add one batch to the log at ``path``; what the log holds already stays readable.

    A batch appears whole, in one step (see :mod:`leadloom.operators.batches`). Writing the same batch
    again replaces it, likewise in one step, so a step that is repeated after a failure does not log
    anything twice, and its addresses never look unwritten in between.
    """
    batch_id = batch_id or uuid.uuid4().hex
    write_batch(entries, path, batch_id)
    return batch_id
