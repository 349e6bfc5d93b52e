"""Address classes as expressions, against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from lapidary.functions import addresses, net


def test_classes_and_forms(spark):
    rng = random.Random(11)
    texts = [None, "", " ", "1.2.3", "1.2.3.4.", "01.2.3.4", "256.1.1.1", "1.2.3.4\n", "::", ":::", "1::2::3", ":1::2", "1:2:3:4:5:6:7::8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::1%eth0", "::1%", "fe80::1%a%b", "12345::", "g::", "::1.2.3.4", "::ffff:1.2.3.256", "1.2.3.4::", "64:FF9B::8.8.8.8", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::%", "2001:DB8::"]
    for network in [ipaddress.ip_network(n) for ranges in (*addresses.REFUSED.values(), addresses.PUBLIC) for n in ranges]:
        ip, last = type(network[0]), 2 ** network.max_prefixlen - 1
        for n in (int(network[0]) - 1, int(network[0]), int(network[-1]), int(network[-1]) + 1, rng.randint(int(network[0]), int(network[-1]))):
            texts.append(str(ip(min(max(n, 0), last))))
    texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    texts += [ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice((-1, 0xFFFF << 96, 0xFFFFFF0000 << 80))).__str__().upper() for _ in range(300)]
    texts += [ipaddress.IPv6Address(0x2001 << 112 | rng.getrandbits(24) << 88).exploded for _ in range(100)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.t, r.why) for r in frame.select("t", addresses.refused(F.col("t")).alias("why")).collect()]
    assert sorted(got, key=str) == sorted(((t, net.address_reason(t)) for t in texts), key=str)
    assert {why for _, why in got} == {None, "malformed", *addresses.REFUSED}
