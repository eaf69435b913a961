"""Wordings of page furniture that were not looked at while the cues were written.

They are kept as they are: if a cue is added because of one of them, the score below says nothing any more."""

from loomwire.llm import furniture

# fmt: off
BODY = {'en':"The council voted on Tuesday to close the bridge for repairs until spring. Residents said they had not been asked.",
'es':"El ayuntamiento votó el martes cerrar el puente hasta la primavera. Los vecinos dijeron que nadie les preguntó.",
'de':"Der Rat stimmte am Dienstag dafür, die Brücke bis zum Frühjahr zu sperren. Die Anwohner sagten, man habe sie nicht gefragt.",
'fr':"Le conseil a voté mardi la fermeture du pont jusqu’au printemps. Les riverains ont dit ne pas avoir été consultés.",
'zh':"市议会周二投票决定将大桥关闭至春季进行维修。居民们表示，没有人征求过他们的意见。"}
FURNITURE = {'en':["Skip to main content","Home | World | Business | Sport","Your privacy choices","Manage preferences","By clicking Accept you agree to our use of cookies.","Get the morning email in your inbox","Share on Facebook","Copy link","5 min read","Listen to this article","Related topics","You may also enjoy","Image source, Reuters","Report this ad","© 2025 The Daily Bridge. All rights reserved.","Contact us | Careers | Accessibility","Subscribe now for unlimited access","Editing by Tom Hill","Written by Jane Field","This article has been corrected"],
'es':["Ir al contenido principal","Portada | Mundo | Deportes | Cultura","Configurar cookies","Recibe nuestra newsletter","Comparte en WhatsApp","Te puede interesar","Más información","Archivado en: Puentes, Ciudad","Foto: Ana Ruiz","Todos los derechos reservados","Hazte suscriptor","Noticias relacionadas"],
'de':["Zum Inhalt springen","Startseite | Politik | Wirtschaft | Sport","Cookie-Einstellungen verwalten","Newsletter bestellen","Artikel teilen","Lesen Sie auch","Mehr zum Thema","Foto: dpa","Alle Rechte vorbehalten","Jetzt Abo abschließen","Von Anna Berger, Berlin","Quelle: dpa"],
'fr':["Aller au contenu","Accueil | Monde | Sport | Culture","Gérer les cookies","Inscrivez-vous à la newsletter","Partager sur Facebook","À lire aussi","Sur le même thème","Crédit photo : AFP","Tous droits réservés","Réservé aux abonnés","Par Marie Dupont","Voir les commentaires"],
'zh':["跳转到主要内容","首页 国际 体育 财经","接受所有Cookie","订阅我们的电子邮件","分享到微信","相关推荐","责任编辑：王明","图片来源：新华社","版权所有 不得转载","点击查看更多","扫描二维码关注我们","返回首页"]}
# fmt: on


def test_unseen_wordings():
    found = lines = lost = 0
    for lang, wordings in FURNITURE.items():
        for i, x in enumerate(wordings):
            at, text = (2, [BODY[lang], BODY[lang], x, BODY[lang]]) if i % 2 else (0, [x, BODY[lang], BODY[lang]])
            mask = furniture.body_mask("\n".join(text))[1]
            found, lines, lost = found + (not mask[at]), lines + 1, lost + sum(not y for j, y in enumerate(mask) if j != at)
    assert lines == 68 and found >= 47 and lost == 0
