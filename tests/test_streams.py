"""Subscription events by any split into batches, with repeats, late events and batches played again."""

import random
from datetime import datetime, timedelta

import pytest
from ledgerweave.operators.ledger import subscription_changes
from ledgerweave.streaming.subscription_stream import EVENT, SubscriptionStore

TYPES = ["checkout.session.completed", "customer.subscription.updated", "customer.subscription.deleted", "invoice.payment_failed", "customer.updated"]


def some_events(n, seed):
    r = random.Random(seed)
    start = datetime(2024, 1, 31)
    return [
        (k, r.choice(TYPES), r.choice([1, 1, 1, 2, 3, None]), r.choice(["plus", "pro", None]), start + timedelta(days=31 * r.randrange(4)), r.choice(["active", "unpaid", "odd"]))
        for k in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_and_replay_ends_as_the_fold_does(spark, tmp_path, seed):
    r = random.Random(seed)
    events = some_events(60, seed)
    shuffled = events + r.sample(events, 20)
    r.shuffle(shuffled)
    cuts = sorted(r.sample(range(1, len(shuffled)), 3))
    batches = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, len(shuffled)], strict=True)]
    store = SubscriptionStore(spark, f"file://{tmp_path}/store", 4)
    for k, batch in enumerate(batches):
        for _ in range(r.choice([1, 2])):
            store.apply(spark.createDataFrame(batch, EVENT), k)
    store.apply(spark.createDataFrame([], EVENT), len(batches))
    whole = SubscriptionStore(spark, f"file://{tmp_path}/whole", 4)
    want = whole.states(subscription_changes(spark.createDataFrame(events, EVENT)).withColumn("bucket", whole.bucket())).drop("bucket")
    got = store.accounts().select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert store.log().count() == store.log().select("event_id").distinct().count()


def test_a_store_without_events_is_empty(spark, tmp_path):
    assert SubscriptionStore(spark, f"file://{tmp_path}/none").accounts().collect() == []
